"""What a task's Python has freed goes back to the system, so that a worker kept for later tasks does not hold it."""

import os

import numpy as np

from wardlens.llm.storage import give_back


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_freed_memory_goes_back():
    held = [np.ones(8000, np.uint8) for _ in range(20_000)]  # 160 MB in pieces that lie in the heap
    last = held[-1:]  # one that is still held at its end
    full = _resident()
    del held
    before = _resident()
    give_back()
    assert full - _resident() > 120e6 and last[0].sum() == 8000
    assert _resident() <= before
