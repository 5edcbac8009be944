"""Secret scans: fixed patterns, and strings that a primed compressor finds novel.

The base patterns are assignments to sensitive names, access keys and long
hexadecimal runs. The method adds spans of kind "novel": a run of key-like
characters that a sensitive word precedes is compressed by zstandard, primed
with a dictionary of identifiers and the code before and behind it; the bytes that
it adds are its marginal cost. Random characters of the same alphabet and length
cost a known number of bytes there; a string that costs nearly as much is reported, so
that hexadecimal or base32 keys, which always compress a little, count like any.
Runs that read as words (few changes between capitals, small letters and digits)
and runs without a letter are not secrets of this kind. Whole texts are scanned,
in one pass without a shuffle and in time linear in the text.

Defined cases: a null text is empty; ties and repeated rows are scanned like
any row; a null doc_id is kept; an empty table gives an empty table; extra
columns are ignored by scan() and kept by redact(), which sets n_chars (of any
numeric type) where a text changed. Spans are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ._shared import sliced, texts_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones drop out whole
_ASSIGNED = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words that make the text behind them sensitive, in lower case.
CONTEXT = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "authorization", "bearer", "signature")
_CONTEXT = re.compile("|".join(sorted(CONTEXT, key=len, reverse=True)))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LEAST = 12
#: Stretches of one kind of character, as words and numbers have them.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Alphabets of keys, the smaller ones first.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567")
ALPHABETS += ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
ALPHABETS += (ALPHABETS[-1] + "+/_=-",)
_SETS = [frozenset(x) for x in ALPHABETS]
#: The primer: what code around secrets usually says, and so costs little.
IDENTIFIERS = (
    "const let var function return import from export default class static void public private protected string String int "
    "config settings environment process.env os.environ getenv client_id client_secret access_token refresh_token id_token "
    "Authorization: Bearer Basic username password passwd passphrase user_name database host port localhost example default "
    "connection_string private_key public_key secret_key access_key api_key apikey session_id cookie signature timestamp "
    "response request headers content-type application/json utf-8 https:// http:// www. .com .org true false null None undefined "
    "BEGIN END RSA PRIVATE KEY CERTIFICATE aws_access_key_id aws_secret_access_key github gitlab token_type expires_in "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_key_here xxxxxxxxxxxxxxxx 000000000000"
)


class Novelty:
    """Marginal compressed bytes of a candidate behind its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primer, write_checksum=False, write_content_size=False).compress

        self.random = functools.lru_cache(1024)(lambda alphabet, n, turn: "".join(random.Random(n + turn).choices(ALPHABETS[alphabet], k=n)))

    def marginal(self, around: str, candidate: str) -> int:
        """Bytes that the candidate adds behind the code around it."""
        around_ = around.encode("utf-8", "surrogatepass")
        return len(self.compress(around_ + candidate.encode())) - len(self.compress(around_))

    def share(self, around: str, candidate: str, turns: int = 4) -> float:
        """The candidate's marginal cost as a share of that of random characters of its alphabet at the same place."""
        chars = set(candidate)
        alphabet = next(i for i, x in enumerate(_SETS) if chars <= x)
        turns = turns if len(candidate) <= 1024 else 1  # the cost of long ones varies little
        expected = min(self.marginal(around, self.random(alphabet, len(candidate), i)) for i in range(turns))
        return self.marginal(around, candidate) / max(1, expected)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(x in low for x in _ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found)


def like_words(run: str) -> bool:
    """Whether a run reads as words and numbers: its stretches of one kind are long, or it has no letter."""
    pieces = _PIECE.findall(run)
    letters = sum(map(len, pieces)) - sum(len(p) for p in pieces if p[0] <= "9")
    digits = any(p[0] <= "9" for p in pieces)
    return not letters or len(run) > (7 if digits else 4) * len(pieces)


def novel_spans(text: str, low: str, taken: list[tuple[int, int, int]], novelty: Novelty, reach: int = 64, around: int = 200, share: float = 0.9) -> list[tuple[int, int, int]]:
    """Candidates up to reach behind a sensitive word, clear of taken spans, that cost at least `share` of random characters.

    Each run of key-like characters is looked at once, from its last sensitive word
    on if it holds one itself.
    """
    if len(low) != len(text):  # lower-casing moved the positions
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    ends = [m.end() for m in _CONTEXT.finditer(low)]
    starts = [s for s, _, _ in taken]
    found = []
    for m in CANDIDATE.finditer(text) if ends else ():
        s, e = m.span()
        last = bisect.bisect_right(ends, e - LEAST) - 1
        if last < 0 or s - ends[last] > reach:
            continue
        s = max(s, ends[last])
        while s < e and text[s] in "+/_=-":
            s += 1
        if e - s < LEAST:
            continue
        before = bisect.bisect_left(starts, e) - 1  # taken spans in order of their start
        if any(s < t_end for _, _, t_end in taken[max(0, before - 8) : before + 1]) or like_words(text[s:e]):
            continue
        if novelty.share(text[max(0, s - around) : s] + text[e : e + around], text[s:e]) >= share:
            found.append((s, 3, e))
    return found


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base, spans for each row of docs(doc_id, text)."""

    def run(batches):
        novelty = Novelty()
        for batch in sliced(batches):
            counts, base, spans = [[], [], [], []], [], []
            for text in texts_of(batch, "text"):
                low = text.lower()
                fixed = base_spans(text, low)
                novel = novel_spans(text, low, fixed, novelty) if any(w in low for w in CONTEXT) else []
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in fixed) if k < 3 else len(novel))
                base.append(spelt(fixed))
                spans.append(spelt(sorted(fixed + novel)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by "[kind]" in text, overlapping ones as the first; n_chars follows where text changed."""
    schema, names = docs.schema, docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names and isinstance(schema["n_chars"].dataType, NumericType) else None

    def clean(text: str, novelty: Novelty) -> str:
        low = text.lower()
        spans = base_spans(text, low)
        spans = sorted(spans + (novel_spans(text, low, spans, novelty) if any(w in low for w in CONTEXT) else []))
        out, end = [], 0
        for s, k, e in spans:
            if s >= end:
                out += [text[end:s], f"[{KINDS[k]}]"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        novelty = Novelty()
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            made = [t and clean(t, novelty) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(made, pa.string())
            if chars is not None:
                kept = batch.column(chars).to_pylist()
                columns[chars] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, texts, made, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")
