"""

    python tools/bench_table.py bench.json > table.md
"""
import json
import sys


def main(path: str) -> None:
    b = json.loads(open(path).read().strip().splitlines()[-1])
    cfg = f"sf{b['sf']}, local[{b['cpus']}], Spark {b['spark']}"
    print("| Key | Cold s | Warm s | Config |")
    print("|---|---|---|---|")
    for k, warm in b["queries"].items():
        print(f"| `{k}` | {b['cold'].get(k, '')} | {warm} | {cfg} |")
    print(f"| **total (warm)** | {round(sum(b['cold'].values()), 2)} | {b['value']} | {cfg} |")
    for k, err in b.get("failed", {}).items():
        print(f"| `{k}` | failed | {err[:60]} | {cfg} |")


if __name__ == "__main__":
    main(sys.argv[1])
