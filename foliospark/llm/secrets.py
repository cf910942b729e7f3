"""Secret scans: fixed rules, and a token-efficiency test for random strings.

A tokenizer writes ordinary text in few tokens and random strings in many. A
run of key-like characters with fewer characters a token than a threshold is
reported, unless it has the form of a known digest or of an identifier.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import keyed_texts

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

LONG = re.compile(r"\S{20,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths of hexadecimal md5, sha1, sha224, sha256, sha384 and sha512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Mean characters a token below which a run counts as random.
MAX_CHARS_A_TOKEN = 2.0

_IS_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_IS_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_IS_NAME = re.compile(r"[/_-]*[A-Za-z]+([/_=-]+[A-Za-z]+)*[/_=-]*[0-9]{0,4}[/_=-]*\Z")
_LETTERS = re.compile(r"[A-Za-z]+")
_IS_NUMBER = re.compile(r"[0-9+/_=-]+\Z")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's three kinds: leftmost matches that do not overlap, without those that are too short."""
    found: dict[str, list[tuple[int, int]]] = {"assign": [], "access": [], "hex": []}
    lower = text.encode("utf-8").lower()
    if any(k in lower for k in KEYWORDS):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


@lru_cache(maxsize=2)
def _encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(rank_path), special_tokens={})


def looks_random(run: str, encoding: tiktoken.Encoding, max_chars_a_token: float = MAX_CHARS_A_TOKEN) -> bool:
    """Whether a run is neither a known form nor written in few tokens."""
    if _IS_NUMBER.match(run) or _IS_UUID.match(run) or (_IS_HEX.match(run) and len(run) in DIGEST_LENGTHS):
        return False
    if _IS_NAME.match(run):  # an identifier only where its words are in the vocabulary; separators cost tokens but prove nothing
        words = _LETTERS.findall(run)
        if sum(map(len, words)) >= max_chars_a_token * sum(len(encoding.encode_ordinary(w)) for w in words):
            return False
    return len(run) < max_chars_a_token * len(encoding.encode_ordinary(run))


def scan(text: str, encoding: tiktoken.Encoding, max_chars_a_token: float = MAX_CHARS_A_TOKEN) -> dict[str, list[tuple[int, int]]]:
    found = base_spans(text)
    base = found["assign"] + found["access"]
    random = []
    for part in LONG.finditer(text):  # hexadecimal and random runs are at least as long and hold no white space
        for m in HEX.finditer(text, *part.span()):
            if m.end() - m.start() >= 24:
                found["hex"].append(m.span())
                base.append(m.span())
        random += [m.span() for m in RUN.finditer(text, *part.span()) if looks_random(m[0], encoding, max_chars_a_token)]
    if random and base:
        random = _outside(random, base)
    return found | {"random": random}


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that overlap none of the base."""
    base = sorted(base)
    starts, reach, far = [a for a, _ in base], [], 0
    for _, b in base:
        far = max(far, b)
        reach.append(far)
    return [(a, b) for a, b in spans if not (k := bisect_left(starts, b)) or reach[k - 1] <= a]


def spans_text(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    ordered = sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in found[kind])
    return ",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in ordered])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every found span, overlapping ones joined, replaced by its kind's mark."""
    out, at = [], 0
    for a, k, b in sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in found[kind]):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, rank_path: str, pattern: str, max_chars_a_token: float = MAX_CHARS_A_TOKEN, with_text: bool = True) -> DataFrame:
    """Scan every text.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and
    (with_text) the redacted text. Offsets are code points, ends exclusive. A
    null text counts as empty and has no spans; an empty table gives an empty
    one; repeated rows and null doc_ids give a row each; other columns are
    ignored. Narrow: no shuffle, one Arrow batch in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(rank_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = scan(text, encoding, max_chars_a_token)
                base = spans_text(found, KINDS[:3])
                rows.append((*(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), spans_text(found, KINDS)) + ((redact(text, found),) if with_text else ()))
            cols = list(zip(*rows)) or [()] * (6 + with_text)
            arrays = [batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"] + ["redacted"] * with_text
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", redacted string" * with_text
    return keyed_texts(docs).mapInArrow(run, ddl)
