"""Secret scans: three fixed kinds of spans, and strings in a sensitive context that zstandard finds nothing like.

Beyond the fixed kinds, every long string on the line of a word such as secret, api key or credential, before or after it, or on the lines below is a candidate. It is compressed with a raw
dictionary made of common identifiers and the text around it, without itself and its copies. What it adds in compressed bytes, against its
length, is its novelty: names, paths and words that the code around has repeated cost little; random strings cost nearly their entropy.
Candidates of high novelty are reported as spans of kind `novel`. Fixed spans are never changed or dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import table, texts

# Letters are spelt in both cases, for Unicode's other case forms do not count.
_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"""(?=[PpSsTtAa])({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

CONTEXT = re.compile(r"(?i:secret|token|passw|pwd|credential|api[ \t_-]{0,3}key|access[ \t_-]{0,3}key|private[ \t_-]{0,3}key|bearer|authorization|auth[ \t_-]{0,3}key|client[ \t_-]{0,3}id|signature|encryption[ \t_-]{0,3}key)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Lines without a candidate that may stand between a context word, or the last candidate below it, and the next; text around a candidate that goes into its dictionary.
NEXT, AROUND = 3, 1024
#: Marginal compressed bytes a byte, from which a candidate is reported, and different characters it has at least.
NOVELTY, VARIETY = 0.72, 10
IDENTIFIERS = " ".join(
    """abstract access account action address admin algorithm alias allow api application argument array assert async attribute auth authentication
    authorization await backend base64 batch begin boolean bucket buffer build bytes cache callback catch certificate channel char class client
    client_id client_secret cluster code column command comment commit component config configuration connection const constructor container content
    context controller cookie count create credential credentials current data database datetime debug decode default define delete description
    digest directory docker document domain double dummy encode encoding encryption endpoint environment error event example exception execute export
    extends false field file filter final float format function generate global group handler hash header host html http https identifier implements
    import index init input insert instance integer interface invalid item json key keyword label length library list local localhost location logger
    login manager master message metadata method model module name namespace node null number object offset operator option order output package
    parameter parent password path pattern payload permission placeholder plugin port prefix primary_key private private_key process production
    profile property protected protocol provider proxy public public_key query queue read record reference refresh_token region register registry
    release remote replace repository request require resource response result return role root route sample schema scope script secret section
    select self sequence server service session settings signature size source standard start state static status storage stream string struct
    subject success suffix super switch system table target task template test text thread throw timeout timestamp title token transaction true type
    undefined unique update upload user username valid value variable vector version view virtual void volatile web where while window worker write
    your_api_key_here changeme xxxxxxxxxxxxxxxx 0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ""".split()
).encode()


def _compressed(data: bytes, dictionary: bytes) -> int:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False)
    return len(c.compress(data))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes a byte of text[start:end], primed with the identifiers and the text around it but equal copies.

    Copies of a name, whose parts are as long as words are, stay: names are what repeats in code.
    """
    copy, size = text[start:end], end - start
    parts = [len(p) for p in PART.findall(copy)]
    if parts and sum(parts) >= 3 * len(parts) and max(parts) <= 12:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    else:
        before = text[max(0, start - AROUND - size) : start].replace(copy, " ")[-AROUND:]
        after = text[end : end + AROUND + size].replace(copy, " ")[:AROUND]
    dictionary = IDENTIFIERS + b" " + (before + " " + after).encode("utf-8", "surrogatepass")
    own = copy.encode()
    return (_compressed(own, dictionary) - _compressed(b"", dictionary)) / len(own)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, by start, then kind. Matches that fail their length are dropped, not retried within."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str):
    """(start, end) of the runs between context words, whole, on lines that have such a word and on those below, as long as candidates go on."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return
    low, nth, left = text.rfind("\n", 0, words[0][0]) + 1, 0, 0
    while low < len(text) and (left or nth < len(words)):
        if not left:
            low = max(low, text.rfind("\n", 0, words[nth][0]) + 1)
        high = text.find("\n", low)
        high = len(text) if high < 0 else high
        at, left = low, left - 1
        while True:
            own = nth < len(words) and words[nth][0] < high
            for m in CANDIDATE.finditer(text, at, words[nth][0] if own else high):
                left = NEXT
                if at == low or m.start() > at or not text[at].isalpha():
                    yield m.span()
            if not own:
                break
            at, nth, left = words[nth][1], nth + 1, NEXT
        low = high + 1


def measured(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float, bool]]:
    """(start, end, novelty, whether it overlaps a fixed span) of every candidate with enough different characters."""
    out = []
    ends = list(itertools.accumulate((b[2] for b in base), max))
    for s, e in candidates(text):
        if len(set(text[s:e])) >= VARIETY:
            i = bisect.bisect_left(base, (e,))
            out.append((s, e, novelty(text, s, e), bool(i and ends[i - 1] > s)))
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of high novelty near a context word that overlap no fixed span."""
    return [(s, 3, e) for s, e, n, fixed in measured(text, base) if n >= NOVELTY and not fixed]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, novel): spans as arrays of (kind, start, end), in code points, end exclusive. Null texts have none."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [(f := base_spans(t), novel_spans(t, f)) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "novel"])

    kind = "array<struct<kind: string, start: int, end: int>>"
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {kind}, novel {kind}")


def redacted(text: str) -> str:
    """text with every span replaced by its kind."""
    base = base_spans(text)
    out, at = [], 0
    for s, k, e in sorted(base + novel_spans(text, base)):
        if e > at:
            out += [text[at : max(at, s)], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, n_candidates, n_confirmed), a row per row of docs.

    n_candidates counts the strings whose novelty was measured, n_confirmed those of them with a high one that fixed spans have already. Null texts
    count as empty and have no spans; an empty table gives no rows; other columns than id and text are not looked at.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                every = measured(t, base)
                novel = [(s, 3, e) for s, e, x, fixed in every if x >= NOVELTY and not fixed]
                n = [sum(k == i for _, k, _ in base) for i in (0, 1, 2)]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + novel), len(novel), len(every), sum(x >= NOVELTY and fixed for _, _, x, fixed in every)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "n_candidates", "n_confirmed"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, n_candidates long, n_confirmed long")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
