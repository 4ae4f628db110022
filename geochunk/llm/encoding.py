"""Garbled text from wrong decoding: a hidden Markov model with one clean state and one state per encoding pair.

Emissions are character bigrams (ASCII characters by class). The clean table is counted on all texts; the table
of a pair follows from it by sending each character through that pair's wrong decoding, so no garbled text is needed to
train on. One state more is that of characters lost for good, which emits their mark. From the clean state every other is
entered at a price and left for free; labelled spans get the inverse.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geochunk.session import materialize

#: Bounds of the texts tests.llm.heldout measures on; fit takes every text.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 100_000

#: A group counts by itself from so many texts on; a character's successors as if it had stood there so often at least.
LEAST_GROUP, LEAST_AFTER = 15, 50
#: A sequence in more than this share of a group's texts belongs to its language, if what it would be undone to is no
#: character of the texts.
OWN_RUN = 0.1
#: A bigram in fewer texts of a group says nothing on whether its text was misread; one says at most so many nats.
LEAST_HELD, MOST_SAID = 3, 2.3

#: A bigram counts as seen in clean text from this share of the texts on, and from 2.
LEAST_DOCS = 0.0007

#: A bigram is usual from this share of all characters, and this count, on.
USUAL, LEAST_USUAL = 1e-6, 5

#: Price, in nats, of entering a state: of a UTF-8 pair, of a pair of single-byte encodings, and of lost characters.
ENTER_UTF8, ENTER_BYTE, ENTER_LOST = 7.5, 9.0, 7.5

UTF8_READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac_roman")
WRITTEN_AS = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852")
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866")

#: The mark of a lost character, the name of its state, and how likely that state emits it.
LOST, LOST_STATE, LOST_SHARE = "\ufffd", "lost", 0.9
_BITS = 21  # of a symbol
_KEY = 1 << _BITS
#: A text to count, squeezed; those of ASCII alone are put together, n of them in a row.
_ROW = "g string, t string, n bigint, classes array<bigint>, runs array<string>"
#: Of what, in which group, of which character or sequence, class or bigram; how often, and in how many texts.
_COUNT = "what string, g string, x string, k bigint, n bigint, docs bigint"
_COUNT_KEYS = ["what", "g", "x", "k"]
_ROWS = 10_000  # counted at once
_FLOOR_CLEAN, _FLOOR_PAIR, _MIX, _MIX_KNOWN = 1e-6, 1e-7, 0.1, 0.02
_CHUNK = 4_000_000
_NEVER = 60.0  # nats
#: Symbols whose scores are held at once.
_STEPS = 1 << 15
#: What an article quotes on purpose, and whether a text can have that.
QUOTED, QUOTE_MARK = r"\\verb\*?([^A-Za-z\s*])[^\n]*?\1", "\\verb"

LOWER, UPPER, DIGIT, SPACE, HYPHEN, QUOTE, TEX, OTHER = range(8)
_CLASS = np.full(128, OTHER, np.int64)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = (
        LOWER if _s.islower() else UPPER if _s.isupper() else DIGIT if _s.isdigit() else SPACE if _s.isspace() else HYPHEN if _s == "-" else QUOTE if _s in "'\"`" else TEX if _s in "\\{}$^_&~" else OTHER
    )


def byte_table(codec: str) -> list[str]:
    """The 256 characters of a single-byte encoding; bytes it leaves undefined stay control characters, as readers do."""
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@dataclass(frozen=True)
class Pair:
    """Text written in ``true`` and read as ``wrong``."""

    true: str
    wrong: str
    stripped: bool = False  # control characters that came of it were removed afterwards

    @property
    def name(self) -> str:
        return f"{self.true}>{self.wrong}" + "-stripped" * self.stripped

    def garble(self, text: str) -> str | None:
        read = _TABLES[self.wrong]
        if self.true == "utf-8":
            out = "".join(read[b] for b in text.encode())
            return "".join(c for c in out if not "\x80" <= c <= "\x9f") if self.stripped else out
        write = _BACK[self.true]
        return None if any(c not in write for c in text) else "".join(read[write[c]] for c in text)

    def restore(self, text: str) -> str | None:
        """The text before the wrong reading; None if there is none."""
        back = _BACK[self.wrong]
        if any(c not in back for c in text):
            return None
        raw = bytes(back[c] for c in text)
        if self.true == "utf-8":
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return None
        return "".join(_TABLES[self.true][b] for b in raw)


_TABLES = {c: byte_table(c) for c in {*UTF8_READ_AS, *WRITTEN_AS, *READ_AS}}
_BACK = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in _TABLES.items()}
PAIRS = [Pair("utf-8", w) for w in UTF8_READ_AS] + [Pair("utf-8", w, True) for w in ("latin-1", "cp1252", "iso8859-15")] + [Pair(t, w) for t in WRITTEN_AS for w in READ_AS if t != w]


def utf8_runs(wrong: str) -> re.Pattern:
    """Sequences that are UTF-8 of a non-ASCII character, read as ``wrong``."""
    t = _TABLES[wrong]
    cls = lambda a, b: "[" + "".join(re.escape(c) for c in t[a : b + 1]) + "]"
    trail = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{trail}|{cls(0xE0, 0xEF)}{trail}{{2}}|{cls(0xF0, 0xF4)}{trail}{{3}}")


def hide_quotes(text: str, quoted: str = QUOTED, mark: str = QUOTE_MARK) -> str:
    """What the pattern ``quoted`` matches becomes blanks of the same length; texts without ``mark`` have none. An empty
    pattern hides nothing."""
    return re.sub(quoted, lambda m: " " * len(m[0]), text) if quoted and mark in text else text


def symbols(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, previous symbol, symbol) wherever one of the two is not ASCII; the text counts as after a blank."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = np.flatnonzero(a > 127)
    at = np.union1d(odd, odd + 1)
    at = at[at < len(a)]
    cur, prev = a[at].astype(np.int64), np.where(at > 0, a[at - 1], 32).astype(np.int64)
    sym = lambda x: np.where(x < 128, _CLASS[np.minimum(x, 127)], x)
    return at, sym(prev), sym(cur)


class Tables:
    """Log likelihood ratios of every pair against clean text, by bigram."""

    def __init__(
        self, texts: list[str], groups: list[str] | None = None, quoted: str = QUOTED, mark: str = QUOTE_MARK, count: Callable[[Sieve], pd.DataFrame] | None = None
    ):
        """quoted, mark: passages to leave out, see hide_quotes. groups: a label of each text, such as its language; the
        clean state takes a bigram as the likeliest of the groups with at least LEAST_GROUP texts has it, so that what is common in one language is odd in none.
        count: gives a sieve's counts over all texts, where these are no list (see fit)."""
        self.quoted, self.mark = quoted, mark
        if count is None:
            rows = pd.concat([_squeeze(texts[i : i + _ROWS], (groups or [""] * len(texts))[i : i + _ROWS], quoted, mark) for i in range(0, max(1, len(texts)), _ROWS)])
            count = lambda sieve: _added(sieve([rows.iloc[i : i + _ROWS] for i in range(0, len(rows), _ROWS)]))
        # for a start, texts with what could be UTF-8 read wrongly are left out, unless it is common among their like and
        # can't come of any character of the texts (being common alone is no proof: a source may be misread throughout)
        first = count(Sieve())
        of = {what: first[first["what"] == what] for what in ("size", "run", "char")}
        size = dict(zip(of["size"]["g"], of["size"]["docs"].tolist()))
        n_texts = sum(size.values())
        known = Counter()
        for c, n in zip(of["char"]["x"], of["char"]["docs"].tolist()):
            known[c] += n
        least = max(2, round(LEAST_DOCS * n_texts))
        real = {c for c, n in known.items() if n >= least}
        held = zip(of["run"]["g"], of["run"]["x"], of["run"]["docs"].tolist())
        usual = {(g, x) for g, x, n in held if size[g] >= LEAST_GROUP and n > OWN_RUN * size[g] and not _undone(x) & real}
        sieve = Sieve(usual, {g for g, n in size.items() if n >= LEAST_GROUP})
        sieve.said = _said(count(sieve))
        pure = count(sieve)
        self._fit(pure)
        sieve.tables = self
        kept = count(sieve)  # what looks garbled must not count as clean
        self._fit(kept)
        self.sizes = {"sample": n_texts} | {name: int(c.loc[c["what"] == "size", "docs"].sum()) for name, c in (("pure", pure), ("clean", kept))}

    def hidden(self, text: str) -> str:
        return hide_quotes(text, self.quoted, self.mark)

    def _fit(self, counts: pd.DataFrame) -> None:
        of = {what: counts[counts["what"] == what] for what in ("size", "class", "bigram")}
        n_texts = int(of["size"]["docs"].sum())
        own = of["size"].loc[(of["size"]["docs"] >= LEAST_GROUP) & (of["size"]["g"] != ""), "g"].tolist()
        by_group: dict = {}
        for name in ["", *own]:
            cl, big = (of[what] if name == "" else of[what][of[what]["g"] == name] for what in ("class", "bigram"))
            classes = np.zeros(8, np.int64)
            np.add.at(classes, cl["k"].to_numpy(np.int64), cl["n"].to_numpy(np.int64))
            by_group[name] = [big.groupby("k")["n"].sum().to_dict(), classes]
        docs = of["bigram"].groupby("k")["docs"].sum().to_dict()
        big, classes = by_group.pop("")
        clean = {(k // _KEY, k % _KEY): n for k, n in big.items()}
        total = max(1, int(classes.sum()) + sum(n for (_, b), n in clean.items() if b > 127))
        # what stands in one or two texts may be garbled text not found yet: it speaks for no clean text
        least = max(2, round(LEAST_DOCS * n_texts))
        rare = {(k // _KEY, k % _KEY) for k, n in docs.items() if n < least}
        tables = [{k: n for k, n in clean.items() if k not in rare}] + [self._garbled(clean, p) for p in PAIRS]
        clean = tables[0]
        keys = sorted({k for t in tables for k in t})
        number = {k: i for i, k in enumerate(keys)}
        words = sorted({x for k in keys for x in k} | set(range(8)))  # the classes come first
        place = {x: i for i, x in enumerate(words)}
        left, right = (np.array([place[k[i]] for k in keys], np.int64) for i in (0, 1))
        odd = np.array([x > 127 for x in words])
        logs = np.empty((len(keys) + 1, len(tables)), np.float32)
        for s, t in enumerate(tables):
            floor = _FLOOR_PAIR if s else _FLOOR_CLEAN
            at, n = np.array([number[k] for k in t], np.int64), np.array(list(t.values()), float)
            a, b = left[at], right[at]
            one, after = np.zeros(len(words)), np.zeros(len(words))
            np.add.at(one, b[odd[b]], n[odd[b]])
            np.add.at(after, a[odd[a]], n[odd[a]])
            one[:8] = after[:8] = classes
            back = np.maximum(floor, one[right] / max(total, one.sum()))
            seen = np.zeros(len(keys))
            seen[at] = n / np.maximum(after[a], n)
            # what a pair's frequent character is never followed by is unlikely there, more than in the open clean state
            mix = np.where(after[left] >= LEAST_AFTER, _MIX_KNOWN, _MIX) if s else _MIX
            logs[:-1, s] = np.log((1 - mix) * seen + mix * back)
            logs[-1, s] = np.log(_MIX * floor)
        for b, cl in by_group.values():
            after = Counter({c: int(n) for c, n in enumerate(cl)})
            for k, n in b.items():
                if k // _KEY > 127:
                    after[k // _KEY] += n
            for k, n in b.items():
                if docs[k] < least:
                    continue
                i = number[k // _KEY, k % _KEY]
                logs[i, 0] = max(logs[i, 0], np.log((1 - _MIX) * n / max(after[k // _KEY], LEAST_AFTER)))
        self.keys = np.array([a * _KEY + b for a, b in keys], np.int64)
        ratio = logs[:, 1:] - logs[:, :1]
        # what clean text has often is no evidence, however often it comes
        usual = np.array([clean.get(k, 0) >= max(LEAST_USUAL, USUAL * total) for k in keys] + [False])
        ratio[usual] = np.minimum(ratio[usual], 0)
        # the last row is that of a lost character, whatever it follows (clean text has none); the last column its state
        lost = np.full((len(logs), 1), -_NEVER)  # it emits nothing else
        self.ratio = np.vstack([np.hstack([ratio, lost]), [*ratio[-1], np.log(LOST_SHARE) - logs[-1, 0]]]).astype(np.float32)
        self.best = self.ratio.max(axis=1)
        self.enter = np.array([*(ENTER_UTF8 if p.true == "utf-8" else ENTER_BYTE for p in PAIRS), ENTER_LOST], np.float32)

    @staticmethod
    def _garbled(clean: dict, pair: Pair) -> dict:
        out: dict = defaultdict(float)
        forms: dict = {}

        def form(s: int, depth: int) -> list[int] | None:
            if s < 128:
                return [s]
            if (s, depth) not in forms:
                t: str | None = chr(s)
                for _ in range(depth):
                    t = pair.garble(t) if t is not None else None
                forms[s, depth] = None if t is None else [int(_CLASS[ord(c)]) if ord(c) < 128 else ord(c) for c in t]
            return forms[s, depth]

        # text may have gone the same wrong way more than once
        for depth, weight in ((1, 1.0), (2, 0.2), (3, 0.05)) if pair.true == "utf-8" else ((1, 1.0),):
            for (a, b), n in clean.items():
                fa, fb = form(a, depth), form(b, depth)
                if not fa or not fb:
                    continue
                out[fa[-1], fb[0]] += n * weight
                for x, y in zip(fb, fb[1:]):
                    out[x, y] += n * weight
        if pair.true == "utf-8":  # whatever the texts lack: any second byte may follow a first one
            t = _TABLES[pair.wrong]
            for lead in range(0xC2, 0xF5):
                for trail in range(0x80, 0xC0):
                    if not (pair.stripped and "\x80" <= t[trail] <= "\x9f"):
                        out[ord(t[lead]), ord(t[trail])] += 0.02
        return dict(out)

    def rows(self, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        k = prev * _KEY + cur
        n = len(self.keys)
        i = np.searchsorted(self.keys, k)
        i[i == n] = 0
        known = np.where(self.keys[i] == k, i, n) if n else np.full(len(k), 0)
        return np.where(cur == ord(LOST), n + 1, known)

    def gain(self, rows: np.ndarray) -> float:
        """By how much the best single stay in any state beats the clean state throughout; with a price to enter and none
        to leave, Viterbi's path leaves the clean state exactly where this is positive. Symbols are taken in blocks, with
        the sums and their least value so far carried on, so memory does not grow with the text."""
        best = -1.0
        if not len(rows) or np.maximum(self.best[rows], 0).sum() <= self.enter.min():
            return best
        total = low = np.zeros(len(self.enter))
        for at in range(0, len(rows), _STEPS):
            c = np.cumsum(self.ratio[rows[at : at + _STEPS]], axis=0, dtype=np.float64) + total
            lows = np.minimum.accumulate(np.vstack([low, c]), axis=0)
            best = max(best, float(((c - lows[:-1]).max(axis=0) - self.enter).max()))
            total, low = c[-1], lows[-1]
        return best

    def suspicious(self, text: str) -> bool:
        _, p, c = symbols(self.hidden(text))
        return self.gain(self.rows(p, c)) > 0

    def _forward(self, rows: np.ndarray, score: np.ndarray, clean: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Viterbi's scores after ``rows``, and for each symbol: which states were entered there, and which state the
        clean one after it came from (-1: itself)."""
        entered, came_from = np.empty((len(rows), len(score)), bool), np.full(len(rows), -1, np.int64)
        for t, e in enumerate(self.ratio[rows].astype(np.float64)):
            new = clean - self.enter
            entered[t] = new > score
            score = np.maximum(score, new) + e
            k = int(score.argmax())
            if score[k] > clean:
                came_from[t], clean = k, float(score[k])
        return score, clean, entered, came_from

    def labels(self, rows: np.ndarray) -> np.ndarray:
        """The state of every symbol on Viterbi's path, -1 for the clean one. Only the scores at the start of each block
        are kept on the way forward; the way back makes each block's choices anew."""
        label = np.full(len(rows), -1, np.int64)
        starts, score, clean = [], np.full(len(self.enter), -np.inf), 0.0
        for at in range(0, len(rows), _STEPS):
            starts.append((at, score, clean))
            score, clean, *_ = self._forward(rows[at : at + _STEPS], score, clean)
        state = -1
        for at, score, clean in reversed(starts):
            *_, entered, came_from = self._forward(rows[at : at + _STEPS], score, clean)
            for t in range(len(entered) - 1, -1, -1):
                if state < 0:
                    state = int(came_from[t])
                    if state < 0:
                        continue
                label[at + t] = state
                if entered[t, state]:
                    state = -1
        return label

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, pair) of the labelled spans, by Viterbi's path, each widened to whole words and whole misread
        sequences, since these are decoded in one way; lost characters are spans of their own state."""
        hidden = self.hidden(text)
        at, p, c = symbols(hidden)
        label = self.labels(self.rows(p, c))
        out, lo, n = [], 0, len(label)
        for hi in [*(np.flatnonzero(np.diff(label)) + 1), n] if n else []:
            if label[lo] >= 0:
                start, end = int(at[lo]), int(at[hi - 1]) + 1
                if label[lo] == len(PAIRS):
                    out.append((start, end, LOST_STATE))
                else:
                    pair = PAIRS[label[lo]]
                    floor = int(at[lo - 1]) + 1 if lo and label[lo - 1] >= 0 else 0
                    roof = int(at[hi]) if hi < n and label[hi] >= 0 else len(hidden)
                    while start > floor and hidden[start - 1].isalpha():
                        start -= 1
                    while end < roof and hidden[end].isalpha():
                        end += 1
                    if pair.true == "utf-8":
                        for m in _RUN_OF[pair.wrong].finditer(hidden, max(floor, start - 3), min(roof, end + 3)):
                            if m.start() < end and m.end() > start:
                                start, end = min(start, m.start()), max(end, m.end())
                    out.append((start, end, pair.name))
            lo = hi
        return out

    def restored(self, text: str) -> tuple[str, list[str]]:
        """The text with each labelled span sent back, again until nothing changes (or a text comes again, as single-byte
        pairs can undo each other); and the pairs undone."""
        undone: list[str] = []
        before: set[int] = set()
        while hash(text) not in before:
            before.add(hash(text))
            parts, at, spans = [], 0, [x for x in self.spans(text) if x[2] != LOST_STATE]
            for lo, hi, name in spans:
                fixed = _undo(text[lo:hi], _BY_NAME[name]) if lo >= at else text[lo:hi]
                if fixed != text[lo:hi]:
                    undone.append(name)
                    parts += [text[at:lo], fixed]
                    at = hi
            if parts:
                text = "".join([*parts, text[at:]])
            elif (other := _undo_runs(text, spans)) is not None:
                undone.append(other[1])
                text = other[0]
        return text, undone


def _undo_runs(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, str] | None:
    """Where no labelled span has an inverse as it stands: the misread sequences that meet one labelled as UTF-8, sent back
    by the first encoding in which they are any, and that pair; a rare sequence says little on which encoding it was."""
    meets = [(lo, hi) for lo, hi, name in spans if name.startswith("utf-8>")]
    for wrong in UTF8_READ_AS if meets else ():
        back = Pair("utf-8", wrong).restore
        fixed = _RUN_OF[wrong].sub(lambda m: (back(m[0]) or m[0]) if any(m.start() < hi and m.end() > lo for lo, hi in meets) else m[0], text)  # noqa: B023
        if fixed != text:
            return fixed, f"utf-8>{wrong}"
    return None


def _undo(span: str, pair: Pair) -> str:
    """Inverse of a pair over the non-ASCII runs of a span; runs that have no inverse stay."""
    whole = pair.restore(span)
    if whole is not None:
        return whole
    return re.sub("[^\x00-\x7f]+", lambda m: pair.restore(m[0]) or m[0], span)


_RUN_OF = {w: utf8_runs(w) for w in UTF8_READ_AS}
_RUNS = list(_RUN_OF.values())


def _runs(text: str) -> set[str]:
    """UTF-8 sequences read wrongly that stand in the text; those all of letters are left out, clean words have them."""
    return {m[0] for r in _RUNS for m in r.finditer(text) if not m[0].isalpha()}


def _undone(run: str) -> set[str]:
    """The characters a sequence may have been before UTF-8 was read wrongly."""
    return {c for w in UTF8_READ_AS if (c := Pair("utf-8", w).restore(run)) is not None}


def _said(counts: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By group: its bigrams and what each says, in nats, for every pair of single-byte encodings on its texts' reading more
    like the group's other texts once that pair is undone.

    Bigrams are compared by the texts of the group that hold them, each once a text: if a part of a language was misread
    in one way, the same words stand in its other texts as they were. Groups below LEAST_GROUP say nothing."""
    pairs = [p for p in PAIRS if p.true != "utf-8"]
    size = counts[(counts["what"] == "size") & (counts["docs"] >= LEAST_GROUP)]
    bigrams = counts[counts["what"] == "bigram"]
    out = {}
    for g in size["g"]:
        b = bigrams[bigrams["g"] == g].sort_values("k")
        keys, n = b["k"].to_numpy(np.int64), b["docs"].to_numpy(np.int64)
        if not len(keys):
            continue
        words, at = np.unique(np.concatenate([keys // _KEY, keys % _KEY]), return_inverse=True)
        left, right = at[: len(keys)], at[len(keys) :]
        said = np.zeros((len(keys), len(pairs)))
        for j, p in enumerate(pairs):
            back, table = _BACK[p.wrong], _TABLES[p.true]
            form = np.array([x if x < 128 else ord(table[back[chr(x)]]) if chr(x) in back else -1 for x in words.tolist()], np.int64)
            to = form[left] * _KEY + form[right]
            i = np.minimum(np.searchsorted(keys, to), len(keys) - 1)
            other = np.where(keys[i] == to, n[i], 0)
            said[:, j] = np.where((n >= LEAST_HELD) & (to != keys), np.log((other + 0.5) / (n + 0.5)), 0)
            said[(form[left] < 0) | (form[right] < 0), j] = -MOST_SAID
        out[g] = keys, np.clip(said, -MOST_SAID, MOST_SAID)
    return out


_BY_NAME = {p.name: p for p in PAIRS}
_OF_CLASS = np.eye(8, dtype=np.int64)[_CLASS]


def squeezed(text: str) -> tuple[str, np.ndarray]:
    """The text without the ASCII characters that stand between two others, so symbols() stay the same; and its ASCII
    characters by class."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    keep = odd = b > 127
    if odd.any():
        keep = odd.copy()
        keep[1:] |= odd[:-1]
        keep[:-1] |= odd[1:]
    return b[keep].tobytes().decode("utf-8", "surrogatepass"), np.bincount(b, minlength=256)[:128] @ _OF_CLASS


def _squeeze(texts: list[str], groups: list[str], quoted: str, mark: str) -> pd.DataFrame:
    """Rows as in _ROW."""
    out, plain = [], {}
    for text, g in zip(texts, groups):
        t, classes = squeezed(hide_quotes(text, quoted, mark))
        if t:
            out.append((g, t, 1, classes, sorted(_runs(t))))
        else:
            n, sums = plain.get(g, (0, 0))
            plain[g] = n + 1, sums + classes
    return pd.DataFrame(out + [(g, "", n, sums, []) for g, (n, sums) in plain.items()], columns=["g", "t", "n", "classes", "runs"])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, previous symbol, symbol) of many texts, as symbols() has them of each."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    at, p, c = symbols("\n".join([*texts, ""]))
    i = np.searchsorted(ends, at, "right")
    own = at != ends[i] - 1
    return i[own], p[own], c[own]


def _added(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """Counts as in _COUNT, of many parts."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return pd.DataFrame({"what": [], "g": [], "x": [], "k": [], "n": [], "docs": []}).astype({"k": np.int64, "n": np.int64, "docs": np.int64})
    return pd.concat(frames).groupby(_COUNT_KEYS, as_index=False)[["n", "docs"]].sum()


@dataclass
class Sieve:
    """Counts a pass over all texts: without ``usual``, their characters and sequences; else the bigrams of those texts that
    hold no misread sequence but usual ones, that no pair of ``said`` speaks for, and that ``tables`` don't find suspicious."""

    usual: set[tuple[str, str]] | None = None  # (group, sequence)
    large: set[str] | None = None  # groups that count by themselves
    said: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
    tables: Tables | None = None

    def __call__(self, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if self.usual is None:
            yield from map(self._characters, batches)
            return
        usual_texts = {x for _, x in self.usual}
        for b in batches:
            pure = [LOST not in t and all((g, x) in self.usual or g not in self.large and x in usual_texts for x in runs) for g, t, runs in zip(b["g"], b["t"], b["runs"])]
            b = b[np.array(pure, bool)]
            for lo, hi in _packs(b["t"].tolist()):
                yield self._bigrams(b.iloc[lo:hi])

    @staticmethod
    def _characters(b: pd.DataFrame) -> pd.DataFrame:
        count: Counter = Counter()
        for g, t, n, runs in zip(b["g"], b["t"], b["n"], b["runs"]):
            count["size", g, ""] += int(n)
            count.update(("run", g, x) for x in runs)
            count.update(("char", "", c) for c in set(t) if c > "\x7f")
        return pd.DataFrame([(*k, 0, 0, n) for k, n in count.items()], columns=[*_COUNT_KEYS, "n", "docs"])

    def _bigrams(self, b: pd.DataFrame) -> pd.DataFrame:
        group, names = pd.factorize(b["g"])
        doc, p, c = _joined(b["t"].tolist())
        own, times = np.unique(doc << 2 * _BITS | p * _KEY + c, return_counts=True)
        d, k = own >> 2 * _BITS, own & (1 << 2 * _BITS) - 1
        kept = np.ones(len(b), bool)
        for i, name in enumerate(names):
            if self.said and name in self.said:
                kept &= ~self._misread(d, k, group == i, *self.said[name])
        if self.tables is not None:
            kept &= ~self._suspicious(len(b), doc, self.tables.rows(p, c))
        size, classes = np.zeros(len(names), np.int64), np.zeros((len(names), 8), np.int64)
        np.add.at(size, group[kept], b["n"].to_numpy(np.int64)[kept])
        if kept.any():
            np.add.at(classes, group[kept], np.stack(b["classes"].to_numpy()[kept]))
        has = kept[d]
        found, at = np.unique(group[d[has]].astype(np.int64) << 2 * _BITS | k[has], return_inverse=True)
        n, docs = np.zeros(len(found), np.int64), np.bincount(at, minlength=len(found))
        np.add.at(n, at, times[has])
        parts = [
            {"what": "size", "g": names, "k": 0, "n": 0, "docs": size},
            {"what": "class", "g": np.repeat(names, 8), "k": np.tile(np.arange(8), len(names)), "n": classes.ravel(), "docs": 0},
            {"what": "bigram", "g": names[found >> 2 * _BITS], "k": found & (1 << 2 * _BITS) - 1, "n": n, "docs": docs},
        ]
        return pd.concat([pd.DataFrame(x) for x in parts]).assign(x="")[[*_COUNT_KEYS, "n", "docs"]]

    @staticmethod
    def _misread(d: np.ndarray, k: np.ndarray, which: np.ndarray, keys: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Of the texts ``which`` says, those that read better with a pair undone; d, k: each text's bigrams, once."""
        out, of = np.zeros(len(which), bool), which[d]
        d, at = d[of], np.searchsorted(keys, k[of])
        hope = np.bincount(d, np.maximum(said.max(axis=1), 0)[at], len(which))
        for i in np.flatnonzero(hope > ENTER_BYTE):
            lo, hi = np.searchsorted(d, [i, i + 1])
            out[i] = said[at[lo:hi]].sum(axis=0).max() > ENTER_BYTE
        return out

    def _suspicious(self, n: int, doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        hope = np.bincount(doc, np.maximum(self.tables.best[rows], 0), n)
        for i in np.flatnonzero(hope > self.tables.enter.min()):
            lo, hi = np.searchsorted(doc, [i, i + 1])
            out[i] = self.tables.gain(rows[lo:hi]) > 0
        return out


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", group: str = "lang", quoted: str = QUOTED, mark: str = QUOTE_MARK) -> Tables:
    """Tables from all texts, of whatever length; grouped by the first two letters of ``group``, if there is such a column.

    The texts are read once and written squeezed; each of the fit's four passes over these brings counts to the driver, a row
    for each bigram (or character, or sequence) of a group. ``key`` plays no part."""
    label = F.substring(F.lower(F.trim(group)), 1, 2) if group in documents.columns else F.lit("")
    texts = documents.where(F.col(text).isNotNull()).select(F.coalesce(label, F.lit("")).alias("g"), F.col(text).alias("t"))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _squeeze(b["t"].tolist(), b["g"].tolist(), quoted, mark)

    rows = materialize(texts.mapInPandas(squeeze, _ROW), "squeezed")

    def count(sieve: Sieve) -> pd.DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(sieve)
        parts = rows.mapInPandas(lambda batches: shared.value(batches), _COUNT)
        sums = parts.groupBy(*_COUNT_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        out = sums.toPandas().astype({"k": np.int64, "n": np.int64, "docs": np.int64})
        shared.destroy()
        return out

    return Tables([], None, quoted, mark, count)


def _packs(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _flag(tables: Tables, texts: list) -> np.ndarray:
    """Whether each text has a span with a label; texts are scanned joined, so short ones cost no call each."""
    flags = np.zeros(len(texts), bool)
    for lo, hi in _packs(texts):
        part = [t or "" for t in texts[lo:hi]]
        joined = "\n".join(map(tables.hidden, part))
        starts = np.cumsum([0, *(len(t) + 1 for t in part)])
        at, p, c = symbols(joined)
        rows = tables.rows(p, c)
        cut = np.searchsorted(at, starts)
        hope = np.concatenate([[0.0], np.cumsum(np.maximum(tables.best[rows], 0), dtype=np.float64)])
        hope = hope[cut[1:]] - hope[cut[:-1]]
        for i in np.flatnonzero(hope > tables.enter.min()):
            flags[lo + i] = tables.gain(rows[cut[i] : cut[i + 1]]) > 0
    return flags


def garbled_documents(documents: DataFrame, tables: Tables, key: str = "doc_id", text: str = "text", restore: bool = True) -> DataFrame:
    """Documents with a labelled span: key, n_spans, pairs (those seen, joined by blanks), and restored if asked for.

    Null and empty texts have none; texts are taken whole; repeated rows come out as often; what cannot be sent back
    stays as it is; further columns are ignored. The scan is one pass without shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            texts = b["text"].tolist()
            out = []
            for i in np.flatnonzero(_flag(t, texts)):
                spans = t.spans(texts[i])
                if not spans:
                    continue
                row = [b["key"].iloc[i], len(spans), " ".join(sorted({s[2] for s in spans}))]
                out.append([*row, t.restored(texts[i])[0]] if restore else row)
            yield pd.DataFrame(out, columns=["key", "n_spans", "pairs", *["restored"] * restore])

    schema = f"key {kind}, n_spans int, pairs string" + ", restored string" * restore
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)
