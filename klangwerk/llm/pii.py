"""Personal data by patterns and by information-theoretic sanitisation (operator 10; DataFrame functions only).

Emails, IP addresses, card numbers and phone numbers are found by pattern and checked (octets, Luhn, digits); so are
secrets: access key ids, tokens of well-known forms, long runs of hexadecimal digits, and values assigned to names like
password.  Their values are the protected entities.  All words of a document with mentions, wherever they stand, are its terms; corpus co-occurrence
estimates how much a term tells about an entity: with probabilities as shares of documents, the disclosure of term t about
entity c is PMI(c; t) / IC(c) = log(p(c,t) / (p(c) p(t))) / -log p(c), which is 1 when t never occurs without c.  Every
occurrence of a term above the threshold is generalised (digits and initials to a class) or removed in the documents of
that entity.  A pair must occur in MIN_SUPPORT different texts, so exact copies of one document prove nothing; near copies
count as different texts.

The texts are read for the mentions and terms, for the document frequencies of terms, and to place what was found.  Equal
texts count as one row with their number of rows, and only entities of MIN_SUPPORT texts are joined with the distinct
words of their texts; counts combine before each shuffle, so an entity or term that is in a third of all documents costs a
row per task; joins are plain equi-joins that adaptive execution may split.

Defined cases: null is an empty text; matches that fail their check are dropped without another try; repeated
rows count as often as they occur, except as support, and get the same spans; a text with very many matches costs little more than
in proportion; a secret inside a longer base match is part
of that; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small_side

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that no run of characters is read from more than one start and none recurses.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character or pair that every match holds: texts without it skip the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Forms of secrets, in the order in which they are tried at a place.
SECRET_FORMS = (
    r"(?:AKIA|ASIA|AGPA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"gh[pousr]_[A-Za-z0-9]{36,}+",
    r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    r"sk-[A-Za-z0-9_-]{20,}+",
    r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]*PRIVATE KEY-----)?",
    r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    r"(?i:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?[\x20\t]?[=:][\x20\t]?[\"']?[^\s\"',;<>]{6,}+",
)
SECRET, SECRET_PATTERN = "secret", r"(?<![A-Za-z0-9])(?:" + "|".join(SECRET_FORMS) + ")"
#: Every secret holds one of these, or is no secret: texts without them skip the patterns.
SECRET_MARKS = r"[0-9=:]|PRIVATE KEY"
SECRET_HINT = r"(?i)akia|asia|agpa|aroa|aida|gh[pousr]_|xox|sk-|eyj|private key|[0-9a-f]{32}|passw|pwd|passphrase|secret|key|token"
WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}'-]*[\p{L}\p{N}]"
MIN_TERM = 3  # characters of a term
THRESHOLD = 0.9  # disclosure
MIN_SUPPORT = 3  # different texts of a pair
_SPAN = "struct<kind:string,begin:int,end:int,value:string>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == SECRET:
        return value.rlike(SECRET_MARKS)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.length(digits).between(14, 19) & _luhn(digits)


def _bind(value: Column, f) -> Column:
    """f(value) with the value computed once, whatever f does with it."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def _running(values: Column, zero: Column, op) -> Column:
    """What op makes of zero and the values before each place.

    A fold that appends copies what it has at each step, so the values are cut into about as many runs as a run has values: runs
    are summed up, the sums are folded, and every run is folded from its own start."""
    empty = lambda at: F.struct(F.array().cast("array<int>").alias("out"), at.alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), op(s["at"], x).alias("at"))
    fold = lambda xs, at: F.aggregate(xs, empty(at), step, lambda s: s["out"])

    def run(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        runs = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width), lambda i: F.slice(xs, i + 1, width))
        return _bind(runs, lambda r: F.flatten(F.zip_with(r, fold(F.transform(r, lambda x: F.aggregate(x, zero, op)), zero), lambda x, at: fold(x, at))))

    return _bind(values, lambda xs: F.when(F.size(xs) > 0, run(xs)).otherwise(F.array().cast("array<int>")))


def _placed_values(text: Column, form: str) -> Column:
    """array<struct<value, begin>> of all matches of a pattern: positions are sums of the lengths before, in code points."""
    values, between = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form)
    pairs = F.arrays_zip(values.alias("value"), F.slice(between, F.lit(1), F.size(values)).alias("gap"))

    def place(ps: Column) -> Column:
        before = _running(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["value"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(ps, before, lambda p, at: F.struct(p["value"].alias("value"), (at + F.length(p["gap"])).alias("begin")))

    return _bind(pairs, place)


def _matches(kind: str, text: Column) -> Column:
    """array<struct<kind, begin, end, value>> of valid matches."""
    form, hint = (SECRET_PATTERN, SECRET_HINT) if kind == SECRET else (PATTERNS[kind], HINTS[kind])
    valid = F.filter(_placed_values(text, form), lambda m: _valid(kind, m["value"]))
    found = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["begin"].alias("begin"), (m["begin"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
    maybe = text.rlike(SECRET_MARKS) & text.rlike(hint) if kind == SECRET else text.rlike(hint)
    return F.when(maybe, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _reached(at: Column, spans: Column, rows: Column, inclusive: bool) -> Column:
    """array<struct<row, reach>>: each row with the furthest end of the spans that begin before ``at(row)`` (or there, if inclusive).

    Spans and rows are sorted by place together, and the furthest end runs along."""
    first = 0 if inclusive else 1  # of spans and rows at one place, which comes first
    marks = F.transform(spans, lambda s: F.struct(s["begin"].alias("at"), F.lit(first).alias("order"), s["end"].alias("end"), F.try_element_at(rows, F.lit(1)).alias("row"), F.lit(False).alias("own")))
    asked = F.transform(rows, lambda r: F.struct(at(r).alias("at"), F.lit(1 - first).alias("order"), F.lit(-1).alias("end"), r.alias("row"), F.lit(True).alias("own")))

    def run(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: e["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        both = F.zip_with(events, reach, lambda e, far: F.struct(e["row"].alias("row"), e["own"].alias("own"), far.alias("reach")))
        return F.transform(F.filter(both, lambda e: e["own"]), lambda e: F.struct(e["row"].alias("row"), e["reach"].alias("reach")))

    return _bind(F.array_sort(F.concat(marks, asked)), run)


def base_spans(text: Column) -> Column:
    """All valid matches in order of place, then kind as listed."""
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    every = F.concat(*(_matches(k, text) for k in KINDS))
    placed = F.transform(every, lambda s: F.struct(s["begin"].alias("begin"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(placed)


def all_spans(text: Column) -> Column:
    """base_spans and the secrets outside them, in order of place."""
    rank = len(KINDS)
    secrets = F.transform(_matches(SECRET, text), lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    def both(base: Column, found: Column) -> Column:
        own = F.transform(F.filter(_reached(lambda s: s["begin"], base, found, True), lambda x: x["reach"] < x["row"]["end"]), lambda x: x["row"])
        return F.when(F.size(found) > 0, F.array_sort(F.concat(base, own))).otherwise(base)

    return _bind(base_spans(text), lambda base: _bind(secrets, lambda found: both(base, found)))


def _words(text: Column) -> Column:
    """The distinct terms of a text, lower case; those inside an email or a secret (no other kind holds letters) are left out."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    plain = F.when(plain.rlike(SECRET_MARKS) & plain.rlike(SECRET_HINT), F.regexp_replace(plain, SECRET_PATTERN, " ")).otherwise(plain)
    found = F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.array_distinct(found), lambda w: F.length(w) >= MIN_TERM), F.lower))


def _places(text: Column, terms: Column, found: Column) -> Column:
    """array<struct<begin, end>> of all occurrences of terms outside the mentions."""
    hits = F.filter(_placed_values(text, WORD), lambda m: F.array_contains(terms, F.lower(m["value"])))
    spans = F.transform(hits, lambda m: F.struct(m["begin"].alias("begin"), (m["begin"] + F.length(m["value"])).alias("end")))
    free = lambda rows: F.filter(_reached(lambda t: t["end"], found, rows, False), lambda x: x["reach"] <= x["row"]["begin"])
    return _bind(spans, lambda rows: F.transform(free(rows), lambda x: x["row"]))


def find_mentions(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, entities (digests of kind and normalised value) and, if it has any, its terms."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"), all_spans(text).alias("found"))

    def entity(s: Column) -> Column:
        value = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"].isin("ip", SECRET), s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
        return F.xxhash64(s["kind"], value)

    return one.select("doc_id", "text_hash", F.array_distinct(F.transform("found", entity)).alias("entities"), F.when(F.size("found") > 0, _words(F.col("text"))).alias("terms"))


#: Terms (or terms of all documents that have disclosing ones) up to which their set is broadcast; beyond it the join is a
#: shuffle join.
MAX_BROADCAST_TERMS = 100_000
#: Terms up to which they stand in the plan.
MAX_LITERAL_TERMS = 2_000
MAX_BROADCAST_TEXT_TERMS = 1_000_000


def _bounded(df: DataFrame, n: int, most: int = MAX_BROADCAST_TERMS) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def _near(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, text_hash, n_docs and terms of each distinct text and entity; n_entity of the entities of enough texts."""
    mentions = settle(find_mentions(docs), "mentions")
    texts = mentions.where(F.size("entities") > 0).groupBy("text_hash").agg(
        F.count("*").alias("n_docs"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = settle(texts, "texts")
    near = texts.select("text_hash", "n_docs", "terms", F.explode("entities").alias("entity"))
    # an entity of fewer texts has no term of enough of them
    of_entity = settle(near.groupBy("entity").agg(F.sum("n_docs").alias("n_entity"), F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT), "entities")
    return near.join(small_side(of_entity.select("entity")), "entity", "left_semi"), of_entity.drop("support")


def disclosing(docs: DataFrame, near: DataFrame, of_entity: DataFrame) -> DataFrame:
    """entity, term and disclosure of all pairs above the threshold."""
    of_pair = settle(near.select("entity", "n_docs", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("n_docs").alias("n_pair"), F.count("*").alias("support"))
                     .where(F.col("support") >= MIN_SUPPORT).drop("support"), "pairs")
    n_docs = docs.count()
    wanted = of_pair.select("term").distinct()
    n_terms = wanted.count()
    counts = of_pair.sparkSession.createDataFrame([], "term string, n_term long")
    if 0 < n_terms <= MAX_LITERAL_TERMS:
        # few terms are picked inside each row, so that only their counts are shuffled
        known = [r[0] for r in wanted.collect()]
        own = F.filter(_words(F.coalesce("text", F.lit(""))), lambda w: w.isin(known))
        counts = docs.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    elif n_terms:
        # counted before they are chosen: a join below the count would carry a row for every document of a frequent term
        counted = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
        counts = counted.join(_bounded(wanted, n_terms), "term")
    n = F.lit(float(max(n_docs, 1)))
    pmi = F.log(F.col("n_pair") * n / (F.col("n_entity") * F.greatest("n_term", "n_pair")))
    ic = -F.log(F.col("n_entity") / n)
    joined = of_pair.join(small_side(of_entity), "entity").join(counts, "term")
    return joined.select("entity", "term", F.when(ic > 0, pmi / ic).alias("disclosure")).where(F.col("disclosure") >= THRESHOLD)


def _placed(docs: DataFrame) -> DataFrame:
    """row (the document, all columns), found (base spans and secrets) and places (begin, end of every disclosing term).

    Base spans are found again in place, so only the terms of texts that have disclosing ones meet a join."""
    near, of_entity = _near(docs)
    pairs = settle(disclosing(docs, near, of_entity).select("entity", "term"), "disclosing")
    own = near.select("text_hash", "entity", F.explode("terms").alias("term")).join(_bounded(pairs, pairs.count()), ["entity", "term"], "left_semi")
    terms = settle(own.groupBy("text_hash").agg(F.collect_set("term").alias("terms")), "terms")
    n = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever the columns are called
    joined = rows.join(_bounded(terms, n, MAX_BROADCAST_TEXT_TERMS), F.xxhash64("row.text") == F.col("text_hash"), "left")
    found = joined.withColumn("found", all_spans(F.coalesce("row.text", F.lit(""))))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return found.select("row", "found", F.when(F.col("terms").isNotNull(), _places(F.col("row.text"), F.col("terms"), F.col("found"))).otherwise(none).alias("places"))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, base and secrets (kind, begin, end), and terms (begin, end)."""
    shown = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end")))
    base, secrets = (shown(F.filter("found", lambda s: (s["kind"] == SECRET) == other)) for other in (False, True))
    return _placed(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"), base.alias("base"), secrets.alias("secrets"), F.col("places").alias("terms"))


#: What stands in place of a match.
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>"}


#: Code points of the parts in which a text is cut, so that no piece is counted from the text's beginning.
PART = 4096


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span (begin, end, kind, in order) replaced; a span that overlaps an earlier one extends it."""
    mask = F.create_map(*(x for k, v in MASKS.items() for x in (F.lit(k), F.lit(v))))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def masked(of: Column, rows: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = F.floor(begin / PART).cast("int")
            near = F.array_join(F.slice(of, first + 1, F.floor(F.greatest(begin, end - 1) / PART).cast("int") - first + 1), "")
            return F.when(end > begin, F.substring(near, begin - first * PART + 1, end - begin)).otherwise("")

        def shown(x: Column, at: Column) -> Column:
            # generalised to a class if it is a name or a code, else removed
            word = F.when(x["kind"] == "term", piece(x["begin"], x["end"]))
            put = F.coalesce(mask[x["kind"]], F.when(word.rlike(r"^\p{Lu}|[0-9]"), F.lit("<TERM>")).otherwise(F.lit("")))
            return F.when(x["begin"] >= at, F.concat(piece(at, x["begin"]), put)).otherwise("")

        ends = _running(F.transform(rows, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        body = F.zip_with(rows, ends, lambda x, at: shown(x, at))
        return F.concat(F.array_join(body, ""), piece(F.array_max(F.transform(rows, lambda x: x["end"])), F.length(text)))

    return _bind(parts, lambda of: _bind(spans, lambda rows: masked(of, rows)))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data masked and disclosing terms generalised or removed."""
    base = F.transform("found", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind")))
    extra = F.transform("places", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit("term").alias("kind")))
    every = _placed(docs).select("row", F.array_sort(F.concat(base, extra)).alias("every"))
    text = F.when(F.size("every") > 0, _masked(F.col("row.text"), F.col("every"))).otherwise(F.col("row.text"))
    return every.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
