"""Articles into passages of a bounded number of tokens.

An article is cut at its headings; a section that fits is one passage, a longer one is packed: tables by rows with their
header repeated, prose by lines, then sentences, then runs of tokens, with some of a window's end carried into the next.
A document is packed on its own in one narrow pass; nothing is shuffled. An article whose heading leaves no room is an
error: it raises, or with ``strict=False`` gives one row with ``error`` and no text. Null bodies have no passages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schemas import CHUNK_DDL

MARGIN = 0.02  # of the budget stays free, since token counts of joined texts don't add up exactly
HEADING = re.compile(r"^(#{1,6})[ \t]+(.*)$", re.MULTILINE)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BLANK_LINES = re.compile(r"\n{2,}")


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, ids: list) -> str: ...


class WordTokenizer:
    """A token for each word between white space."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)


class HeadingTooLong(EngineError, ValueError):
    """A heading prefix that leaves no room for text."""


def sections(body: str) -> list[tuple[tuple[str, ...], str]]:
    """(heading path, text) of each section; text before the first heading has an empty path."""
    marks = list(HEADING.finditer(body))
    out: list[tuple[tuple[str, ...], str]] = []
    lead = body[: marks[0].start()].strip() if marks else body.strip()
    if lead or not marks:
        out.append(((), lead))
    if not marks:
        return out
    path: list[tuple[int, str]] = []
    for mark, end in zip(marks, [m.start() for m in marks[1:]] + [len(body)], strict=True):
        depth = len(mark[1])
        path = [p for p in path if p[0] < depth] + [(depth, mark[2].strip())]
        out.append((tuple(name for _, name in path), body[mark.end() : end].strip()))
    return out


@dataclass(frozen=True)
class Piece:
    """Text that is not cut further, the separator before it, and the tokens of both."""

    text: str
    lead: str
    cost: int


def is_divider(line: str) -> bool:
    """Whether a line divides a table's header from its rows: between bars, three dashes or more a cell, with colons for alignment."""
    line = line.strip()
    cells = [c.strip().removeprefix(":").removesuffix(":") for c in line[1:-1].split("|")]
    return len(line) > 1 and line[0] == line[-1] == "|" and all(len(c) >= 3 and not c.strip("-") for c in cells)


class Packer:
    """Windows of at most ``budget`` tokens for one tokenizer."""

    def __init__(self, tokenizer: Tokenizer, budget: int, overlap: int = 0):
        self.tokenizer, self.budget, self.overlap = tokenizer, budget, overlap

    def cost(self, text: str) -> int:
        return len(self.tokenizer.encode(text))

    def runs(self, text: str) -> list[str]:
        ids = self.tokenizer.encode(text)
        return [self.tokenizer.decode(ids[i : i + self.budget]) for i in range(0, len(ids), self.budget)]

    def lines(self, lines: list[str]) -> list[str]:
        """Whole lines, no overlap; a line that is too long alone is cut by tokens."""
        out, held, used = [], [], 0
        for line in lines:
            cost = self.cost("\n" + line)
            if held and used + cost > self.budget:
                out.append("\n".join(held))
                held, used = [], 0
            if cost > self.budget:
                out += self.runs(line)
            else:
                held.append(line)
                used += cost
        return out + ["\n".join(held)] if held else out

    def table(self, block: str) -> list[str]:
        """Rows under a repeated header; a table without a header, or with one that fills the budget, is plain lines."""
        lines = block.split("\n")
        has_header = len(lines) > 1 and is_divider(lines[1])
        if has_header and len(lines) == 2:
            return [block]
        head = "\n".join(lines[:2])
        room = self.budget - self.cost(f"{head}\n") if has_header else 0
        if room <= 0:
            return self.lines(lines)
        return [f"{head}\n{w}" for w in Packer(self.tokenizer, room).lines(lines[2:])]

    def cut(self, text: str) -> Iterator[tuple[str, str]]:
        """(separator, piece) with the coarsest pieces that fit: lines, sentences, runs of tokens."""
        for block in BLANK_LINES.split(text):
            for i, line in enumerate(block.split("\n")):
                line, lead = line.rstrip(), "\n" if i else "\n\n"
                if not line:
                    continue
                if self.cost(lead + line) <= self.budget:
                    yield lead, line
                    continue
                for sentence in filter(None, SENTENCE.split(line.strip())):
                    if self.cost(lead + sentence) <= self.budget:
                        yield lead, sentence
                        lead = " "
                        continue
                    for run in self.runs(sentence):
                        yield lead, run
                        lead = " "
                    lead = " "

    def pieces(self, text: str) -> list[Piece]:
        out: list[Piece] = []
        for lead, piece in self.cut(text):
            lead = lead if out else ""
            out.append(Piece(piece, lead, self.cost(lead + piece)))
        return out

    def pack(self, pieces: list[Piece]) -> list[str]:
        """Windows of whole pieces; each begins with what fits of the end of the one before."""
        out: list[str] = []
        held: list[Piece] = []
        used = 0
        for piece in pieces:
            if held and used + piece.cost > self.budget:
                out.append(joined(held))
                room, first = min(self.overlap, self.budget - piece.cost), len(held)
                while first and held[first - 1].cost <= room:
                    first -= 1
                    room -= held[first].cost
                held = held[first:]
                used = sum(p.cost for p in held)
            held.append(piece)
            used += piece.cost
        return out + [joined(held)] if held else out

    def body(self, text: str) -> list[str]:
        """Windows of a section: tables by themselves, the prose between them together."""
        out: list[str] = []
        prose: list[str] = []

        def flush():
            out.extend(self.pack(self.pieces("\n\n".join(prose))))
            prose.clear()

        for block in BLANK_LINES.split(text):
            if block.lstrip().startswith("|"):
                flush()
                out.extend(self.table(block))
            elif block.strip():
                prose.append(block)
        flush()
        return out


def joined(pieces: list[Piece]) -> str:
    return "".join([pieces[0].text, *(p.lead + p.text for p in pieces[1:])])


def passages(body: str, title: str, tokenizer: Tokenizer, max_tokens: int = 450, overlap: int = 50) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(heading path, text, tokens) of each passage of an article; the text begins with the headings or the title."""
    for path, text in sections(body):
        if not text:
            continue
        prefix = " > ".join(path) or title
        whole = f"{prefix}\n{text}"
        n = len(tokenizer.encode(whole))
        if n <= max_tokens:
            yield path, whole, n
            continue
        budget = max_tokens - len(tokenizer.encode(f"{prefix}\n")) - math.ceil(MARGIN * max_tokens)
        if budget <= 0:
            raise HeadingTooLong(f"heading prefix {prefix[:80]!r} leaves no room in {max_tokens} tokens")
        for window in Packer(tokenizer, budget, overlap).body(text):
            own = f"{prefix}\n{window}"
            yield path, own, len(tokenizer.encode(own))


def chunk_articles(articles: DataFrame, tokenizer: Tokenizer | None = None, max_tokens: int = 450, overlap: int = 50, strict: bool = True) -> DataFrame:
    """Passages of each article with the columns of the chunks table (and ``error`` if not ``strict``)."""
    tokenizer = tokenizer or WordTokenizer()
    own = articles.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "category", "body_md").filter("body_md IS NOT NULL")
    ddl = CHUNK_DDL if strict else CHUNK_DDL + ", error string"
    names = [c.strip().split(" ")[0] for c in ddl.split(", ")]

    def rows(doc_id, title, category, body):
        try:
            for i, (path, text, n) in enumerate(passages(body, title, tokenizer, max_tokens, overlap)):
                yield (f"{doc_id}#{i:03d}", doc_id, i, list(path), text, category, n, None)
        except HeadingTooLong as e:
            if strict:
                raise HeadingTooLong(f"{doc_id}: {e}") from None
            yield (None, doc_id, None, None, None, category, None, str(e))

    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.string()][: len(names)]

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = list(rows(*row))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*got, strict=True)), types, strict=False)], names=names)

    return own.mapInArrow(run, ddl)


class ChunkArticle:
    """The packer as a table function: rows of the chunks table for one article."""

    def eval(self, doc_id: str, title: str, category: str, body_md: str, max_tokens: int, overlap: int):
        if body_md is not None:
            for i, (path, text, n) in enumerate(passages(body_md, title or "", WordTokenizer(), max_tokens, overlap)):
                yield f"{doc_id}#{i:03d}", doc_id, i, list(path), text, category, n


def register(spark: SparkSession, name: str = "chunk_article") -> None:
    """For SQL: ``SELECT c.* FROM articles, LATERAL chunk_article(doc_id, title, category, body_md, 450, 50) c``."""
    spark.udtf.register(name, F.udtf(ChunkArticle, returnType=CHUNK_DDL))


def limit_report(chunks: DataFrame, max_tokens: int = 450) -> DataFrame:
    """One row: chunks over the budget and over the hard limit, the largest, and five ids over the hard limit."""
    hard = int(max_tokens * (1 + MARGIN))
    ids = chunks.filter(F.col("n_tokens") > hard).orderBy("chunk_id").limit(5).agg(F.array_sort(F.collect_list("chunk_id")).alias("over_hard_ids"))
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("n_tokens") > max_tokens).alias("n_over"), F.count_if(F.col("n_tokens") > hard).alias("n_over_hard"), F.max("n_tokens").alias("max_tokens")).join(F.broadcast(ids))


def check_limits(chunks: DataFrame, max_tokens: int = 450) -> DataFrame:
    """``chunks`` itself; raises if any is over the hard limit."""
    report = limit_report(chunks, max_tokens).first()
    if report.n_over_hard:
        raise EngineError(f"{report.n_over_hard} chunks over the hard limit, among them {report.over_hard_ids}")
    return chunks
