"""Periodic runs of words: Lyndon arrays over an ordered alphabet, with matched extensions used again.

The longest Lyndon word that starts at a place ends before the next smaller suffix, and every run of period q has a root of q
words that is such a longest Lyndon word in one of the two orders of the alphabet (the order and its reverse).  ``lyndon_edges``
finds the next smaller suffixes from left to right.  What it has matched once, up to the rightmost word compared so far, it reads
off the earlier copy of the same words, so every word is matched once: no suffix array, no suffix tree, no hashes of stretches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import map_rows, text_of

Run = tuple[int, int, int]


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int]]:
    """(next, common) by place: where the next smaller suffix begins (the length if there is none), and how many letters both share.

    A suffix that is the beginning of another is the smaller one.  Place i meets the chain i - 1, previous smaller of that, and so
    on; ``met`` and ``shared`` keep all meetings in order.  While i lies inside the copy [at, reach) of [of, ...), its meetings
    are those of its twin in the earlier copy; only from the first one that the copy can't decide are letters compared, and those
    lie at ``reach`` or beyond it.
    """
    n = len(t)
    nxt, common = [n] * n, [0] * n
    prev, prev_common = [-1] * n, [0] * n
    met: list[int] = []
    shared: list[int] = []
    first = [0] * (n + 1)
    at = of = reach = 0
    for i in range(n):
        first[i] = len(met)
        first[i + 1] = first[i]
        if i == 0:
            continue
        j, k, comparing = i - 1, 0, True
        if i < reach:
            comparing = False
            shift = at - of
            twin, below = i - shift, prev[at]
            final = prev[twin]
            for x in range(first[twin], first[twin + 1]):
                e, c = met[x], shared[x]
                if e >= of:
                    mine = e + shift
                elif e > below:  # place ``at`` has ended these
                    continue
                else:
                    mine = e
                if i + c >= reach:
                    j, k, comparing = mine, reach - i, True
                    break
                met.append(mine)
                shared.append(c)
                if e == final:
                    prev[i], prev_common[i] = mine, c
                else:
                    nxt[mine], common[mine] = i, c
                    if e == of == below:  # the first copy's own start is still open here
                        met.append(of)
                        shared.append(c)
                        nxt[of], common[of] = i, c
        if comparing:
            far = by = -1
            while True:
                while i + k < n and t[j + k] == t[i + k]:
                    k += 1
                met.append(j)
                shared.append(k)
                if k > far:
                    far, by = k, j
                if i + k < n and t[i + k] > t[j + k]:
                    prev[i], prev_common[i] = j, k
                    break
                nxt[j], common[j] = i, k
                p, c = prev[j], prev_common[j]
                if p < 0:
                    break
                if k > c:  # the smaller one of j differs from both at the same letter
                    met.append(p)
                    shared.append(c)
                    prev[i], prev_common[i] = p, c
                    break
                j = p
            if i + far >= reach:
                at, of, reach = i, by, i + far
        first[i + 1] = len(met)
    return nxt, common


def _runs_of(t: list[int], exponent: int, shortest: int) -> set[Run]:
    """(start, length, period) of the runs of at least ``exponent`` periods and ``shortest`` letters."""
    n, found = len(t), set()
    for letters in (t, [-x for x in t]):
        nxt, common = lyndon_edges(letters)
        for i in range(n):
            q = nxt[i] - i
            # the leftmost root begins within the first period, so it shares at least this much with what follows it
            if common[i] > (exponent - 2) * q and not (i >= q and nxt[i - q] == i and common[i - q] == common[i] + q):
                left = i
                while left and t[left - 1] == t[left - 1 + q]:  # under one period, as no root begins further left
                    left -= 1
                length = i + q + common[i] - left
                if length >= max(shortest, exponent * q):
                    found.add((left, length, q))
    return found


def _stretches(t: list[int], least: int, shortest: int, again: bool = True) -> list[tuple[int, list[int]]]:
    """(start, letters) of the stretches between letters that occur too seldom for any run to hold them."""
    often = {x for x, n in Counter(t).items() if n >= least}
    out, at = [], 0
    for keep, group in groupby(t, often.__contains__):
        letters = list(group)
        if keep and len(letters) >= shortest:
            out += [(at + s, x) for s, x in _stretches(letters, least, shortest, False)] if again and len(letters) < len(t) else [(at, letters)]
        at += len(letters)
    return out


def word_runs(words: list, exponent: int = 4, shortest: int = 6) -> list[Run]:
    """(start, length, period) of every run of a word list, by start and then period.

    A run is a stretch whose smallest period q fits in at least ``exponent`` times (2 or more), of at least ``shortest`` words,
    that no neighbouring word extends.  Each of its words occurs ``exponent`` times, so rarer words part the list beforehand.
    """
    number: dict = {}
    t = [number.setdefault(w, len(number)) for w in words]
    return sorted((at + s, n, q) for at, letters in _stretches(t, exponent, max(shortest, exponent)) for s, n, q in _runs_of(letters, exponent, shortest))


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, q in runs:
        drop[start + q : start + length] = b"\1" * (length - q)
    return [w for w, gone in zip(words, drop, strict=True) if not gone]


def words_of(text: str) -> list[bytes]:
    """The words of a text, as UTF-8: whatever stands between blanks and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, rewrite: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """(doc_id, n_words, starts, lengths, periods, collapsed) for every row: its runs by start and period, and its text with every run cut to one period.

    ``rewrite`` may replace a row's words (given its id) before they are searched.  A null text and one without words have no runs
    and an empty collapsed text; a very long text is one word list, searched whole in linear time and memory.  Runs may overlap;
    a word that several runs would drop goes once.  Equal rows give equal rows, a null id is kept, an empty table gives an
    empty result, and extra columns of any name are ignored.  There is no shuffle: each task reads its own rows.
    """

    def row(text: str, doc_id: int | None) -> tuple:
        words = words_of(text)
        if rewrite is not None:
            words = rewrite(doc_id, words)
        runs = word_runs(words, exponent, shortest)
        starts, lengths, periods = ([r[i] for r in runs] for i in range(3))
        return len(words), starts, lengths, periods, b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(text_of().alias("text"), doc_id.alias("for_rewrite"), doc_id.alias("doc_id"))
    return map_rows(rows, row, "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string", 2)


def longest_run(found: DataFrame) -> DataFrame:
    """``found`` (of ``find_runs``) as one row of figures and digests.

    n_runs; start, length, period and exponent_milli (1000 times length by period, rounded down) of the run of greatest length,
    ties to the least start and then period, null without runs; SHA-256 of every ``start,length,period`` line and of the collapsed text.
    """
    runs = F.arrays_zip("starts", "lengths", "periods")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["lengths"]).alias("l"), r["starts"].alias("s"), r["periods"].alias("p"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["starts"], F.lit(","), r["lengths"], F.lit(","), r["periods"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"),
        F.floor(F.lit(-1000) * best["l"] / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

