"""Personal data by weak-supervision aggregation, in DataFrame operations only.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Further candidates, shapes that the base
patterns drop or do not cover, are judged: four labelers (strict shape, gazetteer, context words, borders) vote for or
against each span; expectation-maximisation over the counts of vote patterns estimates each labeler's reliability per
kind and each pattern's probability; these soft labels train a naive Bayes classifier over votes and discrete features
of the span, which decides on the further candidates. Votes and features take few values, so the counts that reach the
driver are bounded, whatever the input. Texts are scanned once; nothing of them is shuffled.

A pattern's matches are located by splitting the text at them: what lies between, and the matches, in turn, give code
point offsets. The patterns are written so that each runs in linear time and matches what its plain form matches: a
run of characters is tried from its start, or from the end of the match before it, and never given back.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; null identifiers are kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, table

KINDS = ("email", "ip", "card", "phone")
CHUNK = 512
ROUNDS = 30
CONTEXT = 40
SPAN = "struct<a: int, b: int, s: string>"

# The base patterns (linear forms), further candidate shapes, and the labelers' word lists.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\[\.\] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GUARD = {
    "email": "contains(t, '@')", "ip": r"t RLIKE '[0-9]\\.[0-9]'", "card": "t RLIKE '[0-9](?:[ -]?[0-9]){12}'", "phone": "contains(t, '+')",
}
MORE_GUARD = {
    "email": "(contains(t, 'dot') AND contains(t, 'at'))", "ip": "contains(t, '[.]')", "card": "t RLIKE '[0-9](?:[ -]?[0-9]){12}'", "phone": "t RLIKE '[0-9]{3}[ .-][0-9]{4}'",
}
STRICT = {
    "email": r"@|\(at\)|\[at\]|\{at\}", "ip": f"^{OCTET}(?:(?: ?\\[\\.\\] ?|\\.){OCTET}){{3}}$", "card": "^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$", "phone": r"^\+|\(",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]}]? ?)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|au|mx|br|jp|cn|in)$",
    "ip": r"^(?!0+[.\[ ])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{9,})|\(?[2-9][0-9]{2})",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt|address)\b", "ip": r"(?i)\b(?:ip|host|server|address|addr|ping|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|payment|pay)\b", "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|sms|telefon|téléphone|teléfono|ring)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|version|build|token|key|hash|serial|sku|part|ref|doi|page)\b[^A-Za-z]{0,4}$"
VOTES = ("shape", "known", "cue", "border")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(pattern: str, guard: str) -> str:
    """SQL for the matches of pattern in t, as structs of start, end (code points) and text."""
    zipped = f"arrays_zip(split(t, {_lit(pattern)}, -1) AS p, regexp_extract_all(t, {_lit(pattern)}, 0) AS m)".replace(" AS p", "").replace(" AS m", "")
    step = f"named_struct('pos', s.pos + length(x.`0`) + length(x.`1`), 'out', array_append(s.out, named_struct('a', s.pos + length(x.`0`), 'b', s.pos + length(x.`0`) + length(x.`1`), 's', x.`1`)))"
    chunk = f"aggregate(slice(z, i, {CHUNK}), named_struct('pos', coalesce(try_element_at(c, -1).pos, 0), 'out', CAST(array() AS array<{SPAN}>)), (s, x) -> if(x.`1` IS NULL, s, {step}))"
    whole = f"flatten(transform(aggregate(sequence(1, size(z), {CHUNK}), CAST(array() AS array<struct<pos: int, out: array<{SPAN}>>>), (c, i) -> array_append(c, {chunk})), c -> c.out))"
    return f"if({guard}, element_at(transform(array({zipped}), z -> {whole}), 1), CAST(array() AS array<{SPAN}>))"


DIGITS = "regexp_replace(x.s, '[^0-9]', '')"
LUHN = "aggregate(sequence(1, length(d)), 0, (s, i) -> s + if(i % 2 = 1, CAST(substr(d, -i, 1) AS int), CAST(substr('0246813579', CAST(substr(d, -i, 1) AS int) + 1, 1) AS int))) % 10 = 0"
VALID = {
    "email": "true",
    "ip": f"x.s RLIKE {_lit(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
    "card": f"exists(array({DIGITS}), d -> length(d) BETWEEN 13 AND 19 AND {LUHN})",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}

MORE_VALID = {"card": f"exists(array({DIGITS}), d -> {LUHN})"}


def _judged(kind: str, base: bool) -> str:
    """SQL that adds votes and features to the spans of one kind; 1 for, -1 against, 0 abstains."""
    before, after = f"substring(t, greatest(1, x.a - {CONTEXT - 1}), least(x.a, {CONTEXT}))", "substring(t, x.b + 1, 1)"
    shape = f"if(x.s RLIKE {_lit(STRICT[kind])}, 1, {'-1' if kind in ('ip', 'card') else '0'})"
    known = f"if(x.s RLIKE {_lit(GAZETTEER[kind])}, 1, {'-1' if kind in ('email', 'ip') else '0'})"
    cue = f"CASE WHEN {before} RLIKE {_lit(CUES[kind])} THEN 1 WHEN {before} RLIKE {_lit(AGAINST)} THEN -1 ELSE 0 END"
    border = f"if(right({before}, 1) RLIKE '[\\\\p{{L}}_=/#]' OR {after} RLIKE '[\\\\p{{L}}_=/]', -1, 1)"
    size = f"least(20, length({DIGITS}))" if kind != "email" else "least(20, length(x.s) div 4)"
    return (f"transform({kind}_{'base' if base else 'more'}, x -> named_struct('kind', '{kind}', 'a', x.a, 'b', x.b, 'base', {str(base).lower()}, 'shape', {shape}, 'known', {known}, 'cue', {cue}, 'border', {border}, "
            f"'size', {size}, 'marks', least(4, length(regexp_replace(x.s, '[A-Za-z0-9]', '')))))")  # fmt: skip


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `spans`: base spans and further candidates with votes and features."""
    rows = df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    for k in KINDS:
        rows = rows.withColumn(f"{k}_base", F.expr(f"filter({located(BASE[k], GUARD[k])}, x -> {VALID[k]})"))
    for k in KINDS:
        # what overlaps a base span of its kind, or of a kind listed before it, is no further candidate
        over = " OR ".join(f"exists({o}_base, y -> y.a < x.b AND x.a < y.b)" for o in KINDS)
        rows = rows.withColumn(f"{k}_more", F.expr(f"filter({located(MORE[k], MORE_GUARD[k])}, x -> NOT ({over}) AND {MORE_VALID.get(k, 'true')})"))
    spans = ", ".join(_judged(k, b) for k in KINDS for b in (True, False))
    return rows.select("doc_id", F.expr(f"concat({spans})").alias("spans"))


def reliabilities(counts: list[tuple[tuple[int, ...], float]]) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation for one kind: vote pattern -> probability that the span is personal data."""
    total = sum(n for _, n in counts)
    prior, rate = 0.5, {(j, v, y): (0.7 if (v > 0) == y else 0.15) for j in range(len(VOTES)) for v in (-1, 0, 1) for y in (True, False)}
    post: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for votes, _ in counts:
            yes, no = (math.log(p) + sum(math.log(rate[j, v, y]) for j, v in enumerate(votes)) for y, p in ((True, prior), (False, 1 - prior)))
            post[votes] = 1 / (1 + math.exp(max(-700, min(700, no - yes))))
        for y in (True, False):
            mass = sum(n * (post[v] if y else 1 - post[v]) for v, n in counts)
            for j in range(len(VOTES)):
                for value in (-1, 0, 1):
                    start = 6.0 if (value > 0) == y and value else 1.0 if value else 2.0  # a labeler is better than chance until shown otherwise
                    rate[j, value, y] = (sum(n * (post[v] if y else 1 - post[v]) for v, n in counts if v[j] == value) + start) / (mass + 9.0)
        prior = min(0.99, max(0.01, (sum(n * post[v] for v, n in counts) + 1) / (total + 2)))
    return post


FEATURES = (*VOTES, "size", "marks")


def train(spans: DataFrame) -> dict[tuple[str, str, int], float]:
    """Naive Bayes log-odds by (kind, feature, value), trained on the soft labels; (kind, "", 0) is the prior."""
    rows = spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()
    weights: dict[tuple[str, str, int], float] = {}
    for kind in KINDS:
        own = sorted((tuple(r[f] for f in FEATURES), r.n) for r in rows if r.kind == kind)
        if not own:
            continue
        patterns: dict[tuple[int, ...], float] = {}
        for f, n in own:
            patterns[f[: len(VOTES)]] = patterns.get(f[: len(VOTES)], 0) + n
        post = reliabilities(sorted(patterns.items()))
        yes, no = (sum(n * (p if y else 1 - p) for f, n in own for p in (post[f[: len(VOTES)]],)) for y in (1, 0))
        weights[kind, "", 0] = math.log((yes + 1) / (no + 1))
        for i, name in enumerate(FEATURES):
            for value in {f[i] for f, _ in own}:
                a, b = (sum(n * (p if y else 1 - p) for f, n in own if f[i] == value for p in (post[f[: len(VOTES)]],)) for y in (1, 0))
                weights[kind, name, value] = math.log((a + 1) / (yes + 21)) - math.log((b + 1) / (no + 21))
    return weights


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, counts of base spans, their digest, and all spans."""
    stages = Stages(df.sparkSession, "pii")
    found = stages.keep(candidates(df, id_col, text_col))
    weights = train(found.where(F.size("spans") > 0).select(F.explode("spans").alias("x")).select("x.*"))
    table_ = "map(" + ", ".join(f"'{k}:{f}:{v}', {w!r}D" for (k, f, v), w in sorted(weights.items())) + ")" if weights else "CAST(map() AS map<string, double>)"
    at = lambda f: f"coalesce(try_element_at({table_}, concat(x.kind, ':{f}:', {'x.' + f if f else '0'})), 0D)"
    score = " + ".join(at(f) for f in ("", *FEATURES))
    order = "array_sort({}, (l, r) -> if(l.k <> r.k, l.k - r.k, if(l.a <> r.a, l.a - r.a, l.b - r.b)))"
    ranked = "transform({}, x -> named_struct('k', array_position(array('email', 'ip', 'card', 'phone'), x.kind), 'a', x.a, 'b', x.b, 'kind', x.kind))"
    text = lambda spans: f"array_join(transform({order.format(ranked.format(spans)).replace('l.k - r.k', 'CAST(l.k - r.k AS int)')}, x -> concat_ws(':', x.kind, x.a, x.b)), ',')"
    base = "filter(spans, x -> x.base)"
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    every = f"if(exists(spans, x -> NOT x.base), filter(spans, x -> x.base OR {score} > 0), spans)"
    return found.select("doc_id", *counts, F.sha2(F.encode(F.expr(text(base)), "UTF-8"), 256).alias("base_sha256"), F.expr(text(every)).alias("spans"))


def op7_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
