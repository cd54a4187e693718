"""Byte-level BPE over a global distinct-word shuffle.

Texts are cut into units whose split by the pattern does not depend on what stands around them: where no two white
space characters meet, a unit is a run of other characters with the one space or line end before it; other texts are
cut by the pattern itself. Each distinct unit of the corpus is encoded once (``exchange``), its ids join back by
position, and decoding takes the bytes of each id from the token table. Null and empty texts have no ids. A repeated
row is encoded like any other; columns besides the id and the text are not read. A text longer than a chunk is a chunk of its
own: a worker holds one text at a time and the numbers of its units.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ask_each, buckets_for, chunks, home, pack_ranked, pack_sizes, pack_strings, planes, squeeze, tabled, text_bytes, unpack_ranked, unpack_sizes, unpack_strings, unplanes, unsqueeze, untabled

#: White space as the pattern's engine has it (the Unicode property), which is not Python's.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Larger than other exchanges': a chunk's distinct units grow less than its text.
CHUNK_BYTES = 32 << 20
#: Keys and answers are small and shuffled: they are packed more tightly than payloads.
TIGHT = 19
#: Encoded units that a task keeps for its next entries.
KEPT = 200_000
UNEVEN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def units(text: str, pattern: str) -> list[str]:
    """Keys of the units: ``\\n`` before one after a line end, ``\\r`` before one after nothing, none before one after a space."""
    if not text:
        return []
    if UNEVEN.search(text):
        return ["\r" + p for p in splitter(pattern).findall(text)]
    return ("\r" + text).replace("\n", " \n").split(" ")


def unit_text(key: str) -> str:
    return key if key[0] == "\n" else key[1:] if key[0] == "\r" else " " + key


class Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def id_type(n_vocab: int) -> np.dtype:
    return np.dtype(np.uint16 if n_vocab <= 1 << 16 else np.uint32)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them again.

    With ``digest`` the columns are id, n_tokens, ids_sha256 and decoded_sha256; without, id, ids (array<int>) and
    decoded (binary). Smaller chunks take less memory and send more keys.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    n_buckets = buckets_for(text_bytes(docs, "text"))

    def make(table: pa.Table):
        numbers, rows, sizes = Numbers(), [], []
        take = numbers.__getitem__
        for value in table.column("text"):
            own = units(value.as_py(), pattern)
            sizes.append(len(own))
            rows.append(np.fromiter(map(take, own), np.uint32, len(own)))
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        del rows
        # numbered by how often they stand there: most numbers are then of one byte
        order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        flat, keys = number[flat], list(numbers)
        keys = [keys[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
        to = np.fromiter((xxhash.xxh3_64_intdigest(k) % n_buckets for k in keys), np.uint16, len(keys))
        by = {int(b): [] for b in np.unique(to)}
        for k, b in zip(keys, to.tolist(), strict=True):
            by[b].append(k)
        payload = squeeze(tabled(table.select(["id"])), np.array(sizes, np.uint32).tobytes(), planes(to), *pack_ranked(flat))
        return payload, {b: squeeze(*pack_strings(ks), level=TIGHT) for b, ks in by.items()}

    def resolver():
        enc, done = encoder(path, pattern), {}
        kind = id_type(enc.n_vocab)

        def resolve(blob):
            if len(done) > KEPT:
                done.clear()
            own = []
            for k in unpack_strings(*unsqueeze(blob)):
                got = done.get(k)
                if got is None:
                    got = done[k] = np.array(enc.encode_ordinary(unit_text(k.decode("utf-8", "surrogatepass"))), kind).tobytes()
                own.append(got)
            return squeeze(*pack_sizes([len(x) // kind.itemsize for x in own]), planes(np.frombuffer(b"".join(own), kind)), level=TIGHT)

        return resolve

    def finish(payload, answers):
        ids, sizes, to, *flat = unsqueeze(payload)
        rows, sizes = untabled(ids), np.frombuffer(sizes, np.uint32)
        flat, to = unpack_ranked(*flat), unplanes(to, np.uint16)
        as_text, as_bytes, counts, tokens = [""] * len(to), [b""] * len(to), np.zeros(len(to), np.int64), [None] * len(to)
        names, spelled = token_table(path, pattern)
        for b, blob in answers.items():
            low, high, found = unsqueeze(blob)
            at, lengths, found = np.flatnonzero(to == b), unpack_sizes(low, high), unplanes(found, id_type(len(names))).tolist()
            counts[at], start = lengths, 0
            for i, n in zip(at.tolist(), lengths.tolist(), strict=True):
                own = found[start : start + n]
                start += n
                as_bytes[i] = b"".join([spelled[t] for t in own])
                if digest:
                    as_text[i] = ",".join([names[t] for t in own])
                else:
                    tokens[i] = own
        n_tokens, a, b, start = [], [], [], 0
        for n in sizes.tolist():
            own = flat[start : start + n]
            start += n
            listed = own.tolist()
            n_tokens.append(int(counts[own].sum()))
            decoded = b"".join([as_bytes[i] for i in listed])
            if digest:
                a.append(hashlib.sha256(",".join([as_text[i] for i in listed]).encode()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
            else:
                a.append([t for i in listed for t in tokens[i]])
                b.append(decoded)
        if digest:
            return pa.table({id_col: rows.column("id"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})
        return pa.table({id_col: rows.column("id"), "ids": pa.array(a, pa.list_(pa.int32())), "decoded": pa.array(b, pa.binary())})

    table = chunks(docs, "text", make, "bpe", chunk_bytes)
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else f"`{id_col}` {kind}, ids array<int>, decoded binary"
    return home(table, ask_each(table, n_buckets, resolver), finish, schema)


@lru_cache(maxsize=4)
def token_table(path: str, pattern: str) -> tuple[list[str], list[bytes]]:
    """Decimal form and bytes of each id."""
    enc = encoder(path, pattern)
    n = enc.n_vocab
    spelled = [b""] * n
    for raw, i in enc._mergeable_ranks.items():
        spelled[i] = raw
    return list(map(str, range(n))), spelled
