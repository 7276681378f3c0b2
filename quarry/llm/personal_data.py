"""Personal data spans by weak supervision, in DataFrame and SQL functions alone.

*Base* spans (email, ip, card, phone) are those of the patterns below; they are always found.  Further
*candidates* (written-out email addresses, telephone numbers without a country code, identity numbers)
are judged by labelers that vote for, against or not at all: the strict pattern, gazetteers (top-level
domains, the number ranges of card issuers with their lengths, country calling codes, the area and
exchange codes of the North American plan, ranges never given out), words in the context, the shape, and
the edges.  The votes of all
candidates, base ones included, are counted by pattern (a table whose size the labelers fix), and
expectation-maximisation over it estimates each labeler's reliability without any label.  The
posteriors then train the final classifier of spans, a naive Bayes over features of span and context,
which decides on the candidates that are no base spans.

Positions are code points.  A pattern's matches are told by splitting: gaps and matches alternate, so
their lengths add up to the starts.  The patterns differ from the plain ones only in that a match may
not begin inside a run that has been looked at already; the matches are the same and a run of any length is
read once.

Defined results: a null text has no spans; a text of any length is read whole; repeated rows have the
same spans; spans of different kinds may overlap, an added one none of the base ones; without candidates
nothing is learned or added; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scratch import staged

#: Most texts are told apart by a cheap look first.
DIGIT = "rlike(body, '[0-9]')"
# The plain patterns are email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+ with 13 to 19 digits,
# phone \+[0-9][\x20().0-9-]+[0-9] with 9 to 15 digits.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(body, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", f"{DIGIT} and rlike(body, '[0-9][.][0-9]')"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", f"{DIGIT} and rlike(body, '[0-9](?:[ -]?[0-9]){{12}}')"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(body, '+')"),
}
BASE_KEEP = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> cast(p as double) <= 255)",
    "card": "luhn_check(regexp_replace(x.t, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) between 9 and 15",
}
EXTRA = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+\x20?[\[({]at[\])}]\x20?[a-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[a-z0-9-]++)++", "rlike(body, '(?i)[\\\\[({]at[\\\\])}]')"),
    "phone": (r"(?<![0-9+])(?<![0-9][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![\x20.-]?[0-9])", f"{DIGIT} and rlike(body, '[0-9]{{3}}[.-][0-9]{{4}}')"),
    "id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", f"{DIGIT} and rlike(body, '[0-9]{{3}}-[0-9]{{2}}-')"),
}
ORDER = ("email", "ip", "card", "phone", "id")
CONTEXT = 40
GOOD_WORDS = r"(?i)\b(?:e-?mail|mail|call|tel|telephone|phone|mobile|fax|contact|reach|ip|address|host|card|visa|account|iban|ssn|social security|id)\b"
BAD_WORDS = r"(?i)\b(?:isbn|issn|doi|order|invoice|version|figure|fig|page|pages|part|ref|sku|item|model|ticket|build)\b"
# Fixed values of the gazetteers.
DOMAINS = r"(?i)[.](?:com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|tel|cat|asia|post|app|dev|page|blog|shop|store|online|site|tech|cloud|xyz|example|test|[a-z]{2})$"
CALLING = r"^(?:1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))"
NATIONAL = r"^[(]?[2-9](?!11)[0-8][0-9][)]?[ .-][2-9](?!11)[0-9]{2}[.-][0-9]{4}$"
NEVER = r"^(?:000|666|9)|-00-|0000$"
#: Leading digits of issuers, from and to, and the lengths of their numbers.
ISSUERS = [
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", range(14, 20)), ("36", "36", range(14, 20)), ("38", "39", range(14, 20)),
    ("6011", "6011", range(16, 20)), ("644", "649", range(16, 20)), ("65", "65", range(16, 20)), ("3528", "3589", range(16, 20)), ("62", "62", range(16, 20)), ("50", "50", range(13, 20)), ("56", "58", range(13, 20)), ("63", "63", range(13, 20)), ("67", "68", range(13, 20)),
]


def _digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]', '')"


def _issued(span: str) -> str:
    """SQL of whether a card number lies in an issuer's range and has one of its lengths."""
    return " or ".join(f"(left({_digits(span)}, {len(a)}) between '{a}' and '{b}' and length({_digits(span)}) in ({', '.join(map(str, sizes))}))" for a, b, sizes in ISSUERS)


#: Votes: 0 none, 1 for, 2 against.
LABELERS = {
    "strict": "case when x.base then 1 else 0 end",
    "gazetteer": f"case x.kind when 'email' then case when rlike(regexp_replace(x.t, ' ?[\\\\[({{]dot[\\\\])}}] ?', '.'), '{DOMAINS}') then 1 else 2 end when 'card' then case when {_issued('x.t')} then 1 else 2 end when 'ip' then case when rlike(x.t, '^0') then 2 else 1 end "
    f"when 'phone' then case when x.t like '+%' then case when rlike({_digits('x.t')}, '{CALLING}') then 1 else 2 end when rlike(x.t, '{NATIONAL}') then 1 else 2 end else case when rlike(x.t, '{NEVER}') then 2 else 1 end end",
    "context": "case when rlike(x.before, '{good}') then 1 when rlike(x.before, '{bad}') then 2 else 0 end",
    "shape": "case when rlike(x.t, '([0-9])(?:[ .-]?\\\\1){5}') then 2 when x.kind = 'ip' and rlike(x.before, '(?i)version ?$') then 2 else 1 end",
    "edges": "case when rlike(x.before, '[A-Za-z0-9_]$') or rlike(x.after, '^[A-Za-z0-9_]') then 2 else 1 end",
}
N = len(LABELERS)
THRESHOLD, ROUNDS = 0.5, 25
#: Matches whose positions are added up at once.
BLOCK = 128


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<s, e, t>> of the non-overlapping matches of ``pattern``, leftmost first.

    needs: SQL that holds for every text with a match, and is quicker to tell.  Positions are added up in
    blocks of matches, then over blocks, as an array that grows by one is copied each time.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none, no_offset = F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)"), F.expr("cast(array() as array<int>)")
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("t")))

    def placed(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.length(x["t"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["t"])).alias("e"), x["t"].alias("t")))).alias("out"),
            ),
        )

    def offsets(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), no_offset.alias("out"))
        return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def moved(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, offsets(blocks), lambda b, o: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["t"].alias("t")))))

    def cut(ps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda b: F.slice(ps, b * BLOCK + 1, F.lit(BLOCK)))

    # one-element arrays bind a value, which would else be worked out anew for each use
    found = F.get(F.transform(F.array(pairs), lambda ps: F.when(F.size(ps) == 0, none).otherwise(F.get(F.transform(F.array(F.transform(cut(ps), placed)), moved), F.lit(0)))), F.lit(0))
    return F.when(F.expr(needs), found).otherwise(none)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, body) with cands: array<struct<kind, s, e, base, votes, feats>>."""
    rows = docs
    for kind, (pattern, needs) in BASE.items():
        rows = rows.withColumn(f"b_{kind}", matches(F.col("body"), pattern, needs))
    for kind, (pattern, needs) in EXTRA.items():
        rows = rows.withColumn(f"x_{kind}", matches(F.col("body"), pattern, needs))
    base = ", ".join(f"transform(filter(b_{k}, x -> {BASE_KEEP[k]}), x -> struct('{k}' as kind, x.s as s, x.e as e, x.t as t, true as base))" for k in BASE)
    extra = ", ".join(f"transform(x_{k}, x -> struct('{k}' as kind, x.s as s, x.e as e, x.t as t, false as base))" for k in EXTRA)
    rows = rows.select("doc_id", "body", F.expr(f"concat({base})").alias("base"), F.expr(f"concat({extra})").alias("extra"))
    rows = rows.withColumn("spans", F.expr("concat(base, filter(extra, x -> not exists(base, b -> x.s < b.e and b.s < x.e)))"))
    seen = f"transform(spans, x -> struct(x.kind as kind, x.s as s, x.e as e, x.t as t, x.base as base, substr(body, greatest(1, x.s - {CONTEXT - 1}), least({CONTEXT}, x.s)) as before, substr(body, x.e + 1, {CONTEXT}) as after))"
    votes = ", ".join(v.replace("{good}", GOOD_WORDS.replace("\\", "\\\\")).replace("{bad}", BAD_WORDS.replace("\\", "\\\\")) for v in LABELERS.values())
    feats = (
        "array(concat('kind=', x.kind), concat('digits=', least(20, length(regexp_replace(x.t, '[^0-9]', '')))), concat('parens=', contains(x.t, '(')), "
        f"concat('good=', rlike(x.before, '{GOOD_WORDS.replace(chr(92), chr(92) * 2)}')), concat('bad=', rlike(x.before, '{BAD_WORDS.replace(chr(92), chr(92) * 2)}')), "
        "concat('left=', coalesce(nullif(regexp_extract(x.before, '([(\\\\[:;,#=/]) ?$', 1), ''), 'none')), concat('edge=', rlike(x.after, '^[A-Za-z0-9_]')))"
    )
    return rows.select("doc_id", F.expr(f"transform({seen}, x -> struct(x.kind as kind, x.s as s, x.e as e, x.base as base, array({votes}) as votes, {feats} as feats))").alias("cands"))


def fit(cands: DataFrame) -> dict[str, float]:
    """Log-odds of each feature and the bias (``''``), from the votes of all candidates."""
    # as many rows as there are combinations of votes and features
    table = cands.select(F.explode("cands").alias("c")).groupBy("c.votes", "c.feats").agg(F.count("*").cast("double").alias("n"))
    one = table.agg(F.collect_list(F.struct("votes", "feats", "n")).alias("rows"))
    cells = f"sequence(0, {3 * N - 1})"
    posterior = f"1 / (1 + exp(-greatest(-30D, least(30D, ln(acc.p / (1 - acc.p)) + aggregate(sequence(0, {N - 1}), 0D, (s, l) -> s + ln(acc.a[l * 3 + x.votes[l]]) - ln(acc.b[l * 3 + x.votes[l]]))))))"
    judged = f"transform(rows, x -> struct(x.votes as votes, x.n as n, {posterior} as r))"
    total = "aggregate({q}, 0D, (s, x) -> s + x.n * {r})"
    step = (
        f"transform(array({judged}), q -> struct("
        f"least(0.99D, greatest(0.01D, {total.format(q='q', r='x.r')} / greatest(1D, {total.format(q='q', r='1D')}))) as p, "
        f"transform({cells}, k -> ({total.format(q='filter(q, y -> y.votes[cast(floor(k / 3) as int)] = k % 3)', r='x.r')} + 1D) / ({total.format(q='q', r='x.r')} + 3D)) as a, "
        f"transform({cells}, k -> ({total.format(q='filter(q, y -> y.votes[cast(floor(k / 3) as int)] = k % 3)', r='(1D - x.r)')} + 1D) / ({total.format(q='q', r='(1D - x.r)')} + 3D)) as b))[0]"
    )
    first = f"struct(0.7D as p, transform({cells}, k -> case k % 3 when 1 then 0.6D when 0 then 0.3D else 0.1D end) as a, transform({cells}, k -> case k % 3 when 2 then 0.4D when 0 then 0.4D else 0.2D end) as b)"
    learned = one.select("rows", F.expr(f"aggregate(sequence(1, {ROUNDS}), {first}, (acc, i) -> {step})").alias("acc"))
    soft = learned.select(F.explode(F.expr(f"transform(rows, x -> struct(x.feats as feats, x.n as n, {posterior} as r))")).alias("y"))
    sums = soft.select(F.explode(F.concat("y.feats", F.array(F.lit("")))).alias("f"), F.expr("y.n * y.r").alias("pos"), F.expr("y.n * (1 - y.r)").alias("neg")).groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = {r["f"]: (r["pos"], r["neg"]) for r in sums.collect()}  # one row for each feature value
    if "" not in sums:
        return {"": 0.0}
    from math import log

    pos, neg = sums.pop("")
    return {"": log((pos + 1) / (neg + 1)), **{f: log((a + 1) / (pos + 2)) - log((b + 1) / (neg + 2)) for f, (a, b) in sums.items()}}


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, span_list."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(text, '')").alias("body"))
    cands = staged(with_candidates(body), "personal-candidates")  # read twice, to fit and to score; some per cent of the text
    weights = fit(cands)
    table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) if f for x in (f, float(w))]) if len(weights) > 1 else F.expr("map('', 0D)")
    score = F.expr(f"transform(cands, c -> struct(c.kind as kind, c.s as s, c.e as e, c.base as base, 1 / (1 + exp(-({weights['']}D + aggregate(c.feats, 0D, (z, f) -> z + coalesce(w[f], 0D))))) as score))")
    rank = " ".join(f"when '{k}' then {i}" for i, k in enumerate(ORDER))
    ordered = f"array_sort(filter(judged, c -> c.base or c.score >= {THRESHOLD}D), (l, r) -> case when case l.kind {rank} end <> case r.kind {rank} end then case l.kind {rank} end - case r.kind {rank} end else l.s - r.s end)"
    rows = cands.withColumn("w", table).select("doc_id", score.alias("judged")).select("doc_id", F.expr(ordered).alias("span_list"))
    joined = "array_join(transform({}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')"
    counts = [F.expr(f"cast(size(filter(span_list, c -> c.base and c.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(F.expr(joined.format("filter(span_list, c -> c.base)")), 256).alias("base_sha256"), F.expr(joined.format("span_list")).alias("spans"), "span_list")
