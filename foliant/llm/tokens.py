"""Token counts by prefix dynamic programming.

The encoding of a piece by ranked merges has one last token for each prefix: the one token that ends there and that
stays next to the last token of what is left. So a pass over the piece stores the exact token count of each prefix, and
counts of texts, cuts at a budget and counts of any prefix are sums and look-ups with nothing encoded again. Tables of
distinct pieces are kept by each worker, in a cache of bounded size.

Null texts count as empty, which have no tokens. Repeated rows are each counted, alike. Very long texts are taken whole, one
at a time. A table without rows gives none. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNEVEN, splitter, unit_text
from .shared import slices

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PrefixCounter:
    """Counts for one byte-level tokenizer file (``.json`` of ranked merges with a byte-level pre-tokenizer)."""

    CACHE = 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or model["byte_fallback"]:
            raise ValueError(f"{path} is no byte-level BPE tokenizer")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = splitter(PATTERN)
        back = {c: b for b, c in byte_letters().items()}
        vocab = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.specials and all(c in back for c in t)}
        ranks = {bytes([b]): b for b in range(256)}  # ranks in the order of merges; single bytes come first
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ranks.setdefault(bytes(back[c] for c in a + b), len(ranks))
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        single = self.bpe._encode_single_piece
        self.ids = {t: r for t, r in ranks.items() if t in vocab and single(t) == [r]}
        self.lengths = [[] for _ in range(256)]  # of the tokens that end in a byte, longest first
        for t in self.ids:
            self.lengths[t[-1]].append(len(t))
        self.lengths = [sorted(set(x), reverse=True) for x in self.lengths]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spelled = {r: t for t, r in self.ids.items()}
        self.unit_counts: dict[str, int] = {}

    def table(self, raw: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece, from the empty one on."""
        n, ids, pairs = len(raw), self.ids, self.pairs
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in self.lengths[raw[i - 1]]:
                if size > i:
                    continue
                t = ids.get(raw[i - size : i])
                if t is None:
                    continue
                before = last[i - size]
                if before >= 0:
                    ok = pairs.get((before, t))
                    if ok is None:
                        if len(pairs) >= 4 * self.CACHE:
                            pairs.clear()
                        ok = pairs[before, t] = self.bpe._encode_single_piece(self.spelled[before] + self.spelled[t]) == [before, t]
                    if not ok:
                        continue
                last[i], count[i] = t, count[i - size] + 1
                break
        return count

    def unit(self, key: str) -> int:
        n = self.unit_counts.get(key)
        if n is None:
            if len(self.unit_counts) >= self.CACHE:
                self.unit_counts.clear()
            n = self.unit_counts[key] = sum(self.table(p.encode("utf-8", "surrogatepass"))[-1] for p in self.split.findall(unit_text(key)))
        return n

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        out = [text]
        for s in self.specials:
            if s in text:
                out = [y for x in out for y in ([x] if x in self.specials else [z for part in x.split(s) for z in (part, s)][:-1])]
        return [x for x in out if x]

    def count(self, text: str | None) -> int:
        total = 0
        for part in self.parts(text or ""):
            if part in self.specials:
                total += 1
            elif UNEVEN.search(part):
                total += sum(self.unit("\r" + p) for p in self.split.findall(part))
            else:
                keys = ("\r" + part).replace("\n", " \n").split(" ")
                try:
                    total += sum(map(self.unit_counts.__getitem__, keys))
                except KeyError:
                    total += sum(map(self.unit, keys))
        return total

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts of all prefixes by code points, from the empty one on.

        A prefix may end inside a piece: white space there joins the white space before it, and a cut contraction
        falls apart, so such prefixes are split anew from their piece's start, the rest is read from the tables.
        """
        out, total, before, base = [0], 0, "", 0
        for part in self.parts(text or ""):
            if part in self.specials:  # a special string that is cut is ordinary text after the part before it
                out += [base + c for c in self.prefixes_plain(before + part[:-1])[len(before) + 1 :]]
                total += 1
                out.append(total)
                before, base = "", total
            else:
                counts, before, base = self.prefixes_plain(part), part, total
                out += [total + c for c in counts[1:]]
                total += counts[-1]
        return np.array(out, np.int64)

    def prefixes_plain(self, text: str) -> list[int]:
        pieces = self.split.findall(text)
        out, total, blank, blank_start = [0], 0, "", 0
        for p in pieces:
            contraction = p[0] == "'" and p in ("'re", "'ve", "'ll")
            if p.isspace() or (p[0] == " " and blank):
                # white space so far is one piece wherever the prefix ends in it
                lead = p if p.isspace() else " "
                start, at = (blank, blank_start) if blank else ("", total)
                for i in range(1, len(lead) + 1):
                    out.append(at + self.table((start + lead[:i]).encode())[-1])
                rest = self.by_char(p)[len(lead) + 1 :]
                out += [total + c for c in rest]
                total += self.table(p.encode("utf-8", "surrogatepass"))[-1]
                if p.isspace():
                    out[-1] = at + self.table((start + lead).encode())[-1]
                    blank, blank_start = start + p, at
                else:
                    blank = ""
            else:
                counts = self.by_char(p)[1:]
                if contraction:
                    counts[1] = self.table(b"'")[-1] + self.table(p[1:2].encode())[-1]
                out += [total + c for c in counts]
                total += counts[-1]
                blank = ""
        return out

    def by_char(self, piece: str) -> list[int]:
        counts, at, out = self.table(piece.encode("utf-8", "surrogatepass")), 0, [0]
        for c in piece:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(counts[at])
        return out

    def cut(self, text: str | None, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        within = np.flatnonzero(self.prefixes(text) <= limit)
        return int(within[-1])


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, n_tokens, over_limit for every row; null texts count as empty. One narrow pass, no shuffle."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        own = counter(path)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            counts = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def token_prefixes(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and prefix_tokens (array<bigint>): element i + 1 is the token count of the first i code points."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        own = counter(path)
        for batch in batches:
            for i in range(batch.num_rows):  # a long text has a long array: a row at a time
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own.prefixes(batch.column(1)[i].as_py())], pa.list_(pa.int64()))], names=[id_col, "prefix_tokens"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, prefix_tokens array<bigint>")


def truncated(df: DataFrame, limit: int, text_col: str = "text", prefix_col: str = "prefix_tokens") -> DataFrame:
    """The longest prefix within a budget, from stored prefix counts alone: ``text_col`` is cut, rows stay."""
    best = F.array_max(F.filter(F.sequence(F.lit(1), F.size(prefix_col)), lambda i: F.get(F.col(prefix_col), i - 1) <= limit))
    return df.withColumn(text_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), best - 1))


def budget_prefix(cumulative: list[int], limit: int) -> int:
    """How many whole texts of a list fit a budget, from their cumulative counts."""
    return bisect_right(cumulative, limit)
