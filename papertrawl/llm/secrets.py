"""Secret scans: fixed patterns, and random strings by their token efficiency.

The patterns find assignments, access keys and long hexadecimal runs. On top, runs of key characters are encoded
with a public byte-pair vocabulary: words and names need few tokens for their characters, random strings many. A
run with fewer characters per token than a limit is a secret, unless it is a digest of known length or a
well-known identifier, or lies inside a span that a pattern has already found. Words joined to a secret would hide it,
so the parts of a run outside such spans are tested by themselves, and so are their pieces between separators: between
all of them, and between those that base64 or its form for addresses does not use. Spans that overlap become one.

Runs and pieces between separators count from MIN_PIECE characters on; under MIN_RUN - 4 they must mix letters and
digits or have a capital after a small letter, since short invented words and names look random as well.

The vocabulary's path is a parameter, read on the driver and sent to the executors once: a file of under 1 MB.

Defined results: a null text is empty and has no spans; a doc_id may be null; repeated rows give repeated rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text before merging, a fixed value that belongs to it.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs with separators inside and pieces without are tested from these lengths on; fewer characters per token is random.
MIN_RUN, MIN_PIECE, MAX_CHARS_PER_TOKEN = 20, 12, 1.9
KINDS = ("assign", "access", "hex", "random")
# ---- fixed patterns ----
_KEYWORD = re.compile("passw|secret|token|api", re.ASCII | re.IGNORECASE)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 characters or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_PIECE},}}")
#: All separators, and those outside of base64 and of its form for addresses.
_CUTS = (re.compile("[^/=]+"), re.compile("[^_=-]+"), re.compile("[^/_=+-]+"))
_MIXED = re.compile("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]")
#: Known digests by their number of hexadecimal digits, and identifiers in groups (8-4-4-4-12).
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                     r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
_IDENTIFIER = re.compile(r"(?:urn:)?(?:uuid:)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+|=+|-+|_+|\++|/+")
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
#: Longest piece handed to the encoder at once; merging is not linear in a piece's length.
_PIECE = 4096


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """Built once a task, in about a tenth of a second; a cached function would not travel with the task's code."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("given", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, encode) -> float:
    return len(run) / sum(len(encode(run[i:i + _PIECE])) for i in range(0, len(run), _PIECE))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def outside(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch outside some spans."""
    parts = []
    for start, end in sorted(spans):
        if start > a:
            parts.append((a, min(start, b)))
        a = max(a, end)
        if a >= b:
            return parts
    return [*parts, (a, b)]


def is_random(run: str, encode, limit: float) -> bool:
    """Whether a run or piece is long enough for a test, and random."""
    if len(run) < MIN_RUN and (len(run) < MIN_PIECE or _CUTS[-1].fullmatch(run) is None
                               or len(run) < MIN_RUN - 4 and not _MIXED.search(run)):
        return False
    return not _DIGEST.fullmatch(run) and not _IDENTIFIER.fullmatch(run) and chars_per_token(run, encode) < limit


def random_spans(text: str, base: list[tuple[int, int, str]], encode, limit: float) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        if _DIGEST.fullmatch(m[0]) or _IDENTIFIER.fullmatch(m[0]):
            continue
        taken = [(a, b) for a, b, _ in base if a < m.end() and m.start() < b]
        random: list[tuple[int, int]] = []
        for a, b in outside(m.start(), m.end(), taken):
            if is_random(text[a:b], encode, limit):
                random.append((a, b))
                continue
            for c, d in outside(a, b, [u.span() for u in _UUID.finditer(text, a, b)]):
                # a run without separators is its only piece and has been tested
                pieces = {(p.start(), p.end()) for cut in _CUTS for p in cut.finditer(text, c, d)} - {(a, b)}
                random += [(p, q) for p, q in pieces if is_random(text[p:q], encode, limit)]
        for a, b in sorted(random):
            if found and a < found[-1][1]:
                found[-1] = found[-1][0], max(b, found[-1][1])
            else:
                found.append((a, b))
    return [(a, b, "random") for a, b in found]


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, by start, then kind as listed in KINDS."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value).encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = base + random_spans(text, base, encode, limit)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
