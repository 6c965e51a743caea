"""Secret scans with multipart credential linking. DataFrame and SQL functions only.

Matches are found by the engine's regular expressions over whole texts: the pieces between matches and the matches
themselves give every position by running sums, in chunks, so that the work grows with the matches (but for a factor of
their number divided by CHUNK squared, which counts from millions on). No text leaves the JVM and no row is shuffled.

Base kinds: assign, access, hex. Weak kinds, which alone mean little: `secret` (a bare run of exactly 40 characters of
the base64 alphabet, which a '=' may precede) and `endpoint` (a URL). Each access identifier opens a scope of `scope` code points on both sides;
the weak candidates are interval-joined with the scopes, both sorted, by binary search. A secret is reported when it touches an access identifier's
scope; an endpoint when it touches one in which a secret part (assign, hex or reported secret) lies as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: Fixed patterns. assign: group 2 is the value.
NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SECRET = r"[A-Za-z0-9/+_=-]{40,}"
#: What the operator looks for: 40 characters with no further one beside them, but after a '=' (NAME=value). SECRET, with
#: which the SQL is written, takes the name and the value as one run.
BARE_SECRET = r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+_=-])"
ENDPOINT = r"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+(:[0-9]+)?[A-Za-z0-9/_.-]*"
#: A whole run of hex digits of at least 24; as runs are maximal, these are the base matches that pass.
LONG_HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
BASE = KINDS[:3]
SCOPE = 200
#: Matches whose positions are summed up one after another.
CHUNK = 128


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with value as a variable, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """SQL for array<struct<s, k, e, v>> of one kind, in order: s and e are 0-based code points, v the match. keep: over v."""
    p = _quoted(pattern)
    step = "named_struct('at', s.at + length(x.g) + length(x.v), 'out', concat(s.out, array(named_struct('s', s.at + length(x.g), 'k', {k}, 'e', s.at + length(x.g) + length(x.v), 'v', x.v))))".format(k=KINDS.index(kind))
    pairs = f"transform(filter(arrays_zip(split(_t, {p}, -1), regexp_extract_all(_t, {p}, 0)), x -> x['1'] IS NOT NULL), x -> named_struct('g', x['0'], 'v', x['1']))"
    none = "cast(array() AS array<struct<s: int, k: int, e: int, v: string>>)"
    chunks = _let("pairs", pairs, f"transform(sequence(0, cast(ceil(size(pairs) / {CHUNK}) AS int) - 1), i -> slice(pairs, i * {CHUNK} + 1, {CHUNK}))")
    sizes = "transform(chunks, c -> aggregate(c, 0, (n, x) -> n + length(x.g) + length(x.v)))"
    starts = f"slice(aggregate({sizes}, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n))), 1, size(chunks))"
    all_ = _let("chunks", chunks, f"flatten(zip_with(chunks, {starts}, (c, at) -> aggregate(c, named_struct('at', at, 'out', {none}), (s, x) -> {step}, s -> s.out)))")
    return f"CASE WHEN regexp_like(_t, {p}) THEN filter({all_}, m -> {keep.format(v='m.v')}) ELSE {none} END"


def _touching(scope: int, a: str, b: str) -> str:
    return f"{a}.s < {b}.e + {scope} AND {b}.s < {a}.e + {scope}"


def _touches(scope: int, x: str, spans: str) -> str:
    """Whether x touches one of the spans (a variable; sorted, without overlaps): the last that starts before x ends also
    ends last of those, so it decides."""
    middle = "shiftright(p.lo + p.hi, 1)"
    step = f"if(p.lo >= p.hi, p, if(element_at({spans}, {middle} + 1).s < {x}.e + {scope}, named_struct('lo', {middle} + 1, 'hi', p.hi), named_struct('lo', p.lo, 'hi', {middle})))"
    halvings = f"sequence(1, cast(ceil(log2(size({spans}) + 1)) AS int) + 1)"
    before = f"aggregate({halvings}, named_struct('lo', 0, 'hi', size({spans})), (p, i) -> {step}, p -> p.lo)"
    return _let("last", before, f"if(last > 0, element_at({spans}, last).e + {scope} > {x}.s, false)")


def _joined(name: str) -> str:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.k + 1)"
    return f"array_join(transform(array_sort(transform({name}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))), x -> concat({names}, ':', x.s, ':', x.e)), ',')"


def scan_spans(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """df with one more column, `spans_found`: array<struct<s, k, e, v>>, base spans and linked weak ones."""
    value = "length(regexp_replace({v}, " + _quoted(rf"""^({NAMES})["']?\x20*[:=]\x20*["']?""") + ", '')) >= 6"
    t = df.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    t = t.withColumn("_assign", F.expr(_spans("assign", ASSIGN, value)))
    t = t.withColumn("_access", F.expr(_spans("access", ACCESS, "length({v}) >= 20")))
    t = t.withColumn("_hex", F.expr(_spans("hex", LONG_HEX)))
    none = "slice(_access, 1, 0)"
    near = lambda weak, strong: _let("scopes", strong, f"filter({weak}, w -> {_touches(scope, 'w', 'scopes')})")
    t = t.withColumn("_secret", F.expr(f"CASE WHEN size(_access) > 0 THEN {near(_spans('secret', BARE_SECRET), '_access')} ELSE {none} END"))
    parts = " OR ".join(_touches(scope, "a", f"parts.{k}") for k in ("assign", "hex", "secret"))
    t = t.withColumn("_open", F.expr(_let("parts", "named_struct('assign', _assign, 'hex', _hex, 'secret', _secret)", f"filter(_access, a -> {parts})")))
    t = t.withColumn("_endpoint", F.expr(f"CASE WHEN size(_open) > 0 THEN {near(_spans('endpoint', ENDPOINT), '_open')} ELSE {none} END"))
    return t.withColumn("spans_found", F.expr("concat(_assign, _access, _hex, _secret, _endpoint)")).drop("_t", "_open")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: id_col, n_assign, n_access, n_hex, n_secret, n_endpoint, base_sha256, spans.

    Null text is empty text: no spans, the hash of the empty string. Repeated rows give repeated results, an empty table
    an empty one. Other columns are not read, whatever their names.
    """
    t = scan_spans(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", scope)
    base = F.expr(_joined("concat(_assign, _access, _hex)"))
    return t.select(
        F.col("_id").alias(id_col),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.expr(_joined("spans_found")).alias("spans"),
    )


def spans_sql(scope: int = SCOPE) -> str:
    """The same rows in DuckDB's SQL over the table `documents`."""

    def q(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def spans(kind: str, pattern: str, keep: str) -> str:
        p = q(pattern)
        gaps, hits = f"string_split_regex(t, {p})", f"regexp_extract_all(t, {p}, 0)"
        return f"""list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{
            's': (list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(({hits})[1:i-1], lambda g: length(g))), 0))::BIGINT,
            'k': {KINDS.index(kind)},
            'e': (list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + list_sum(list_transform(({hits})[1:i], lambda g: length(g))))::BIGINT,
            'v': ({hits})[i]}}), lambda m: {keep})"""

    def text(lists: str) -> str:
        names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][x.k + 1]"
        return f"coalesce(array_to_string(list_transform(list_sort(list_transform({lists}, lambda m: {{'s': m.s, 'k': m.k, 'e': m.e}})), lambda x: {names} || ':' || x.s || ':' || x.e), ','), '')"

    def near(weak: str, strong: str) -> str:
        return f"list_filter({weak}, lambda w: len(list_filter({strong}, lambda a: {_touching(scope, 'w', 'a')})) > 0)"

    value = "length(regexp_replace(m.v, " + q(rf"""^({NAMES})["']?\x20*[:=]\x20*["']?""") + ", '')) >= 6"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, {spans('assign', ASSIGN, value)} AS _assign, {spans('access', ACCESS, 'length(m.v) >= 20')} AS _access,
  {spans('hex', LONG_HEX, 'true')} AS _hex, {spans('secret', SECRET, "length(m.v) = 40 AND NOT regexp_matches(m.v, '[_=-]')")} AS weak,
  {spans('endpoint', ENDPOINT, 'true')} AS urls FROM docs),
linked AS (SELECT *, {near('weak', '_access')} AS _secret FROM base),
opened AS (SELECT *, {near('_access', 'list_concat(list_concat(_assign, _hex), _secret)')} AS _open FROM linked),
ended AS (SELECT *, {near('urls', '_open')} AS _endpoint FROM opened)
SELECT doc_id, {', '.join(f'len(_{k})::BIGINT AS n_{k}' for k in KINDS)},
  sha256({text('list_concat(list_concat(_assign, _access), _hex)')}) AS base_sha256,
  {text('list_concat(list_concat(list_concat(list_concat(_assign, _access), _hex), _secret), _endpoint)')} AS spans
FROM ended"""
