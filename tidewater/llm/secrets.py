"""Secret scans: fixed patterns, and Shannon entropy in windows that slide over candidate strings. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import plainly, running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the quantifier's least can't hold a longer run, so the length test may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: The order in which entropy counts characters; '=' pads and counts too.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WINDOW = 20
#: Bits of a character's count in a window (it is at most WINDOW), and counts that a long holds.
COUNT_BITS, PACKED = 5, 12
#: Character class of a candidate: (name, pattern of the whole string, least bits per character in the best window).
CLASSES = [("digits", r"^[0-9]+$", 9.9), ("hex", r"^[0-9a-fA-F]+$", 2.9), ("base36", r"^[0-9a-z_=-]+$", 3.6), ("base64", r"^.+$", 3.8)]
#: Candidates that look like secrets and aren't: samples, identifiers, dates, counting runs, file and web paths.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx|0123456789|abcdefgh|(.)\1{5}"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|^/|//|(?<![a-z])(?:[a-z]++[/_-]){3}"
)


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"""' + pattern + '"""'


def entropy(s: str) -> str:
    """SQL for the largest entropy, in bits a character, of a ``WINDOW``-long window of string ``s``.

    One pass: a character that enters or leaves changes its count and the sum of c ln c by one term each. The counts are
    packed into a few longs, which makes a step cheap however many characters the alphabet has.
    """
    f = "if({0} > 0, {0} * ln({0}), 0D)"
    codes = f"transform(split({s}, ''), ch -> instr('{ALPHABET}', ch) - 1)"
    leave = f"if(i > {WINDOW}, get(h, i - {WINDOW + 1}), -1)"
    place = lambda c: f"'{c}q', greatest({c}, 0) div {PACKED}, '{c}s', cast({COUNT_BITS} * (greatest({c}, 0) % {PACKED}) as int)"
    step = f"transform(array(named_struct('e', get(h, i - 1), 'l', {leave})), y -> named_struct('i', i, 'e', y.e, 'l', y.l, {place('y.e')}, {place('y.l')}))[0]".replace("'y.", "'")
    steps = f"transform(array({codes}), h -> transform(sequence(1, size(h)), i -> {step}))[0]"
    one = lambda c: f"if(j = x.{c}q, shiftleft(1L, x.{c}s), 0L)"
    counts = f"transform(a.c, (n, j) -> n + {one('e')} - if(x.l < 0, 0L, {one('l')}))"
    count = lambda c: f"(shiftrightunsigned(a.c[x.{c}q], x.{c}s) & {(1 << COUNT_BITS) - 1})"
    gain = f"{f.format('(' + count('e') + ' + 1)')} - {f.format(count('e'))}"
    loss = f"if(x.l < 0, 0D, {f.format('(' + count('l') + ' - 1)')} - {f.format(count('l'))})"
    total = f"if(x.e = x.l, a.t, a.t + {gain} + {loss})"
    best = f"if(x.i >= {WINDOW}, greatest(a.b, ln({WINDOW}D) - {total} / {WINDOW}D), a.b)"
    return (
        f"aggregate({steps}, named_struct('c', array_repeat(0L, {-(-len(ALPHABET) // PACKED)}), 't', 0D, 'b', 0D), "
        f"(a, x) -> named_struct('c', {counts}, 't', {total}, 'b', {best}), a -> a.b / ln(2D))"
    )


def found(df: DataFrame, text: str, pattern: str, into: str, kind: str, keep: str) -> DataFrame:
    """Adds array ``into`` of (start, kind, stop, hit): matches of ``pattern`` whose text ``hit`` (group ``g``) passes ``keep``.

    Places are code points: the lengths of what lies between matches and of the matches, summed along the text.
    """
    group = 2 if kind == "0" else 0
    p = F.lit(pattern)
    none = F.array().cast("array<string>")
    some = F.col(text).rlike(pattern)
    df = df.withColumns({
        "_m": F.when(some, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none),
        "_g": F.when(some, F.regexp_extract_all(text, p, F.lit(group))).otherwise(none),
        "_gap": F.when(some, F.split(text, pattern)).otherwise(none),
    })
    df = df.withColumn("_len", F.expr("zip_with(_m, slice(_gap, 1, size(_m)), (m, g) -> length(m) + length(g))"))
    df = df.withColumn("_end", F.when(F.size("_len") > 0, F.expr(running("_len"))).otherwise(F.array().cast("array<int>")))
    made = f"transform(_m, (m, i) -> named_struct('start', _end[i] - length(m), 'kind', {kind}, 'stop', _end[i], 'hit', _g[i]))"
    return df.withColumn(into, F.expr(f"filter({made}, s -> {keep})")).drop("_m", "_g", "_gap", "_len", "_end")


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with arrays ``_base`` and ``_all`` of (start, kind, stop, hit), by start, then kind.

    Kinds: 0 assign, 1 access, 2 hex, 3 entropy. A null or empty text has none. Base spans always stay; an
    entropy span is dropped if it is allow-listed, has no digit, or touches a base span.
    """
    df = found(df, text, ASSIGN, "_assign", "0", f"length(s.hit) >= {ASSIGN_LEAST}")
    df = found(df, text, ACCESS, "_access", "1", "true")
    df = found(df, text, HEX, "_hex", "2", "true")
    digit = "s.hit rlike '[0-9]' and s.hit rlike '[A-Za-z]'"
    df = found(df, text, CANDIDATE, "_cand", "3", digit)
    df = df.withColumn("_cand", F.filter("_cand", lambda s: ~s["hit"].rlike(ALLOWED)))
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_cand", F.expr("filter(_cand, s -> not exists(_base, b -> b.start < s.stop and s.start < b.stop))"))
    least = "case " + " ".join(f"when s.hit rlike '{p}' then {t}D" for _, p, t in CLASSES) + " end"
    df = df.withColumn("_cand", F.expr(f"filter(_cand, s -> {entropy('s.hit')} >= {least})"))
    return df.withColumn("_all", F.array_sort(F.concat("_base", "_cand"))).drop("_cand")


def listed(column: str) -> str:
    names = "array('assign', 'access', 'hex', 'entropy')"
    return f"array_join(transform({column}, s -> concat({names}[s.kind], ':', s.start, ':', s.stop)), ',')"


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans, for each document."""
    got = spans(docs.select("doc_id", "text"))
    return got.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(listed("_base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(listed("_all")).alias("spans"),
    )


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark``; spans that overlap become one mark. Clean texts stay as they are."""
    return plainly(docs, lambda d: _redact(d, mark))


def _redact(docs: DataFrame, mark: str) -> DataFrame:
    text = "text"
    got = spans(docs)
    reach = (
        "aggregate(sequence(0, cast(ceil(log2(greatest(size(_all), 1))) as int)), transform(_all, s -> s.stop), "
        "(a, k) -> transform(a, (x, i) -> greatest(x, if(i >= shiftleft(1, k), a[greatest(i - shiftleft(1, k), 0)], 0))))"
    )
    got = got.withColumn("_reach", F.when(F.size("_all") > 0, F.expr(reach)).otherwise(F.array().cast("array<int>")))
    part = f"if(i > 0 and s.start < _reach[greatest(i - 1, 0)], '', concat(substring({text}, prior + 1, s.start - prior), '{mark}'))"
    part = part.replace("prior", "if(i > 0, _reach[greatest(i - 1, 0)], 0)")
    clean = f"concat(array_join(transform(_all, (s, i) -> {part}), ''), substring({text}, element_at(_reach, -1) + 1))"
    got = got.withColumn(text, F.when(F.size("_all") > 0, F.expr(clean)).otherwise(F.col(text)))
    return got.withColumn("n_chars", F.length(text).cast("long"))
