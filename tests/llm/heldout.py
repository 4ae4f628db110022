"""Recall and precision of problem 10's model on texts it never saw: python -m tests.llm.heldout FOLDER [SEED].

Documents are split in two by a hash. The tables are fitted on one half as it is (wrongly decoded texts included). Of the
other half, texts in which a second model, fitted on that half alone, finds nothing are taken as clean; half of these,
drawn by a seed, are garbled by a pair drawn from all that can write the text, whole or in a passage, and all are given to
the first model.
"""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter

import duckdb

from geochunk.llm import encoding as E

SIZES = ("1-4", "5-19", "20-")


def _foreign(text: str) -> int:
    return sum(c > "\x7f" for c in text)


def measure(folder: str, seed: int = 0, fit_on: int = 0) -> dict:
    rows = duckdb.sql(f"SELECT doc_id, text, lower(substr(trim(coalesce(lang, '')), 1, 2)) AS g FROM '{folder}/documents.parquet' WHERE length(text) BETWEEN 1 AND {E.SAMPLE_CHARS} ORDER BY doc_id").fetchall()
    halves = [[(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 2 == k] for k in (fit_on, 1 - fit_on)]
    tables, judge = (E.Tables(*map(list, zip(*h[: E.SAMPLE_DOCS]))) for h in halves)
    rest = [t for t, _ in halves[1]]
    rest = [t for t, bad in zip(rest, E._flag(judge, rest)) if not bad]
    rnd, cases = random.Random(seed), []
    for t in rest:
        if not _foreign(tables.hidden(t)) or rnd.random() < 0.5:
            cases.append((t, t, "", ""))
            continue
        lo, hi = 0, len(t)
        if rnd.random() < 0.5:  # a passage around one of the foreign characters
            at = rnd.choice([i for i, c in enumerate(tables.hidden(t)) if c > "\x7f"])
            lo, hi = max(0, at - rnd.randint(0, 400)), min(len(t), at + rnd.randint(1, 400))
        kinds = [p for p in E.PAIRS if not p.stripped and (g := p.garble(t[lo:hi])) is not None and g != t[lo:hi]]
        utf8 = [p for p in kinds if p.true == "utf-8"]
        pair = rnd.choice(utf8 if rnd.random() < 0.5 or len(utf8) == len(kinds) else [p for p in kinds if p.true != "utf-8"])
        n = _foreign(tables.hidden(t)[lo:hi])
        cases.append((t, t[:lo] + pair.garble(t[lo:hi]) + t[hi:], "utf-8" if pair.true == "utf-8" else "single-byte", SIZES[(n > 4) + (n > 19)]))
    found = E._flag(tables, [c[1] for c in cases])
    hit, all_, back = Counter(), Counter(), Counter()
    for (clean, text, kind, size), f in zip(cases, found):
        all_[kind, size] += 1
        hit[kind, size] += bool(f)
        if kind and f:
            back[kind, size] += tables.restored(text)[0] == clean
    garbled = [k for k in all_ if k[0]]
    true = sum(hit[k] for k in garbled)
    return {
        "fitted": tables.sizes, "clean": all_["", ""], "false": hit["", ""], "garbled": sum(all_[k] for k in garbled),
        "recall": true / max(1, sum(all_[k] for k in garbled)), "precision": true / max(1, true + hit["", ""]),
        "by": {" ".join(k): (all_[k], round(hit[k] / all_[k], 3), round(back[k] / max(1, hit[k]), 3)) for k in sorted(garbled)},
    }


if __name__ == "__main__":
    print(measure(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 0))
