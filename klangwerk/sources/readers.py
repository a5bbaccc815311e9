"""Readers of the source formats (SR).  All are declarative: text or columnar scans, then column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klangwerk.functions import text as X

_ENTRY = "struct<word:string,lang_code:string,pos:string,pos_title:string,tags:array<string>,raw_tags:array<string>,categories:array<string>,senses:array<struct<tags:array<string>,raw_tags:array<string>,categories:array<string>>>,sounds:array<struct<ipa:string,tags:array<string>,raw_tags:array<string>>>>"
_NAME = "struct<language:string,value:string>"
_ITEM = (f"struct<id:string,type:string,labels:map<string,{_NAME}>,descriptions:map<string,{_NAME}>,aliases:map<string,array<{_NAME}>>,"
         "sitelinks:map<string,struct<site:string,title:string>>,claims:map<string,array<string>>>")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, plain, gzip or bzip2; column value."""
    return spark.read.text(path)


def json_lines(rows: DataFrame, schema: str) -> DataFrame:
    """A struct per line; lines that are not JSON objects give null and stay countable (column ok)."""
    parsed = F.from_json(F.regexp_replace("value", r"^\s*\[?\s*|\s*,?\s*\]?\s*$", ""), schema)
    return rows.where(F.trim("value").rlike(r"^\s*[\[,]?\s*\{")).select(parsed.alias("r"), "value").withColumn("ok", F.col("value").rlike(r"\}\s*[,\]]?\s*$") & F.col("r").isNotNull())


def dictionary(rows: DataFrame, language: str = "de", longest: int = 80) -> DataFrame:
    """SR-01, SR-18: words of one language from dictionary entries, with their pronunciations."""
    r = json_lines(rows, _ENTRY).where("ok").select("r.*").where((F.col("lang_code") == language) & (F.length("word") <= longest) & F.col("word").rlike(r"^[\p{L}][\p{L}\p{M}'’-]*$"))
    return r.select("word", X.normalize_surface("word").alias("normalized"), "pos", F.filter(F.transform(F.coalesce("sounds", F.array().cast("array<struct<ipa:string,tags:array<string>,raw_tags:array<string>>>")), lambda s: s["ipa"]), lambda i: i.isNotNull()).alias("ipa"))


def corpus_counts(rows: DataFrame, source: Column) -> DataFrame:
    """SR-02: form and count of tab-separated lines (first and last field), summed per source."""
    f = F.split("value", "\t")
    typed = rows.select(F.trim(F.element_at(f, 1)).alias("form"), F.element_at(f, -1).try_cast("long").alias("n"), source.alias("source"))
    return typed.where(F.col("n").isNotNull() & F.col("form").rlike(r"^[\p{L}][\p{L}\p{M}'’-]*$")).groupBy("source", F.lower("form").alias("form")).agg(F.sum("n").alias("n"))


def ranked_forms(spark: SparkSession, path: str, required: tuple[str, ...] = ("rank", "form")) -> DataFrame:
    """SR-03: a tab-separated ranking; missing columns and ranks that are not 1..n are errors."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"ranking lacks columns: {', '.join(missing)}")
    df = df.withColumn("rank", F.col("rank").cast("long"))
    n, low, high, kinds = df.agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    if n and (low, high, kinds) != (1, n, n):
        raise ValueError("ranks are not contiguous from 1")
    return df


def pronouncing_dictionary(rows: DataFrame) -> DataFrame:
    """SR-04: surface, normalized, pronunciation and alternate number of lines ``WORD(2)  PH ON ES``; comments are skipped."""
    v = F.trim("value")
    head, rest = F.regexp_extract(v, r"^(\S+)\s+(.+)$", 1), F.trim(F.regexp_extract(v, r"^(\S+)\s+(.+)$", 2))
    surface = F.regexp_replace(head, r"\(\d+\)$", "")
    return rows.where(~v.startswith(";;;") & (head != "") & (rest != "")).select(
        surface.alias("surface"), X.normalize_surface(surface).alias("normalized"), rest.alias("pronunciation"), F.expr("try_cast(nullif(regexp_extract(trim(value), '^\\\\S+?\\\\((\\\\d+)\\\\)\\\\s', 1), '') as int)").alias("alternate"))


def frequency_buckets(spark: SparkSession, path: str) -> DataFrame:
    """SR-06: word, bucket and zipf of a MessagePack list: a header, then one list of words per hundredth of a step down."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                rows = [(w, i, (900 - i) / 100) for i, bucket in enumerate(unpack(bytes(content))[1:]) for w in bucket]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["word", "bucket", "zipf"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, bucket int, zipf double")


def unpack(raw: bytes):
    """A MessagePack value: maps, lists, strings, integers, null and booleans; trailing bytes are an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(raw):
            raise ValueError("truncated MessagePack")
        return raw[at - n : at]

    number = lambda n, signed=False: int.from_bytes(take(n), "big", signed=signed)

    def value():
        kind = number(1)
        if kind < 0x80 or kind >= 0xE0:
            return kind if kind < 0x80 else kind - 256
        if kind < 0x90:
            return {value(): value() for _ in range(kind & 15)}
        if kind < 0xA0:
            return [value() for _ in range(kind & 15)]
        if kind < 0xC0:
            return take(kind & 31).decode()
        if kind in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[kind]
        if kind in (0xCC, 0xCD, 0xCE, 0xCF):
            return number(1 << (kind - 0xCC))
        if kind in (0xD0, 0xD1, 0xD2, 0xD3):
            return number(1 << (kind - 0xD0), True)
        if kind in (0xD9, 0xDA, 0xDB):
            return take(number(1 << (kind - 0xD9))).decode()
        if kind in (0xDC, 0xDD):
            return [value() for _ in range(number(2 << (kind - 0xDC)))]
        if kind in (0xDE, 0xDF):
            return {value(): value() for _ in range(number(2 << (kind - 0xDE)))}
        raise ValueError(f"unsupported MessagePack type {kind:#x}")

    out = value()
    if at != len(raw):
        raise ValueError("trailing MessagePack bytes")
    return out


def entity_items(rows: DataFrame, categories: dict[str, list[str]], languages: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """SR-07/08: entities of the given categories (category to the ids that mark it), a raw text test before the parse."""
    marks = sorted({q for ids in categories.values() for q in ids})
    hint = F.lit(False)
    for q in marks:
        hint = hint | F.col("value").contains(f'"{q}"')
    item = json_lines(rows.where(hint), _ITEM).where("ok").select("r.*").where(F.col("id").rlike("^Q[0-9]+$") & (F.coalesce("type", F.lit("item")) == "item"))
    held = F.flatten(F.map_values("claims"))
    own = F.array_compact(F.array(*(F.when(F.arrays_overlap(held, F.array(*map(F.lit, ids))), F.lit(c)) for c, ids in categories.items())))
    names = F.flatten(F.array(*(F.concat(
        F.array(F.struct(F.lit(g).alias("language"), F.col("labels")[g]["value"].alias("surface"), F.lit(True).alias("preferred"))),
        F.transform(F.coalesce(F.col("aliases")[g], F.array().cast(f"array<{_NAME}>")), lambda a: F.struct(a["language"].alias("language"), a["value"].alias("surface"), F.lit(False).alias("preferred")))) for g in languages)))
    return item.withColumn("categories", own).where(F.size("categories") > 0).select(
        F.col("id").alias("entity"), "categories", F.element_at("categories", 1).alias("category"), F.filter(names, lambda n: n["surface"].isNotNull() & (F.trim(n["surface"]) != "")).alias("names"),
        F.size(F.filter(F.map_keys("sitelinks"), lambda s: s.rlike("wiki$"))).alias("sitelinks"), F.aggregate(F.map_values("claims"), F.lit(0), lambda n, c: n + F.size(c)).alias("statements")).where(F.size("names") > 0)


def entity_names(items: DataFrame) -> DataFrame:
    """SR-08: a row per entity, language and normalised name; the label wins over an alias."""
    n = items.select("entity", F.explode("names").alias("n")).select("entity", "n.language", X.normalize_surface("n.surface").alias("normalized"), F.struct(~F.col("n.preferred"), "n.surface").alias("k"), "n.surface", "n.preferred")
    return n.groupBy("entity", "language", "normalized").agg(F.min_by(F.struct("surface", "preferred"), "k").alias("b")).select("entity", "language", "normalized", "b.surface", "b.preferred")


def qrank(rows: DataFrame) -> DataFrame:
    """SR-09: entity and rank of comma-separated lines; other lines are skipped."""
    m = lambda g: F.regexp_extract(F.trim("value"), r"^(Q[0-9]+)\s*,\s*([0-9]+)", g)
    return rows.where(m(1) != "").select(m(1).alias("entity"), m(2).cast("long").alias("qrank"))


def sparql_terms(rows: DataFrame, names: list[str]) -> DataFrame:
    """SR-10/19: terms of tab-separated lines: IRIs without brackets, literals without quotes, type and language; escapes decoded."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")

    def term(raw: Column) -> Column:
        body = F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*+)"', 1)
        for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"')):
            body = F.regexp_replace(body, rf"(?<!\\)((?:\\\\)*)\\{code}", f"$1{char}")
        body = F.regexp_replace(body, r"\\\\", r"\\")
        return F.when(raw == "", None).when(raw.startswith("<") & raw.endswith(">"), F.substring(raw, 2, F.length(raw) - 2)).when(raw.startswith('"'), body).otherwise(raw)

    return rows.select(*(term(F.coalesce(F.get(fields, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)))


def entity_id(term: Column) -> Column:
    """SR-19: Q-number at the end of an IRI; null without one."""
    found = F.regexp_extract(term, r"(?:^|/)(Q[0-9]+)$", 1)
    return F.when(found != "", found)


#: Markers of phrase types, and of obsolete words.
PHRASE_TYPES = (("proverb", "sprichw[oö]rt|proverb"), ("idiom", "redewendung|idiom"), ("fixed_expression", "phraseolog|feste[rn]? ausdruck|fixed expression"), ("figurative_expression", "figurativ|figürlich|metaphor"))
HISTORICAL = "historisch|veraltet|obsolete|archaic|dated|historical"


def phrases(rows: DataFrame, language: str = "de", least: int = 2, most: int = 16, longest: int = 240) -> DataFrame:
    """SR-11, SF-28/29: multi-word entries with types and whether they are still in use."""
    e = json_lines(rows, _ENTRY).where("ok").select("r.*").where(F.col("lang_code") == language)
    word = F.trim(F.regexp_replace("word", r"\s+", " "))
    none = F.array().cast("array<string>")
    list_of = lambda c: F.coalesce(c, none)
    senses = F.coalesce("senses", F.array().cast("array<struct<tags:array<string>,raw_tags:array<string>,categories:array<string>>>"))
    of_sense = F.transform(senses, lambda s: F.concat(list_of(s["tags"]), list_of(s["raw_tags"]), list_of(s["categories"])))
    own = F.concat(list_of(F.col("tags")), list_of(F.col("raw_tags")))
    marks = F.transform(F.concat(own, list_of(F.col("categories")), F.flatten(of_sense)), lambda m: F.lower(F.translate(m, "_-", "  ")))
    old = lambda a: F.exists(a, lambda m: F.lower(m).rlike(HISTORICAL))
    state = F.when(old(own), "historical_only").when(F.size(of_sense) == 0, "current_or_unmarked").when(F.forall(of_sense, old), "historical_only").when(F.exists(of_sense, old), "mixed").otherwise("current_or_unmarked")
    kinds = F.array_compact(F.array(*(F.when(F.exists(marks, lambda m: m.rlike(p)), F.lit(k)) for k, p in PHRASE_TYPES), F.when(F.lower(F.coalesce("pos", "pos_title")).contains("phrase"), F.lit("phrase"))))
    out = e.select(word.alias("canonical"), X.normalize_surface(word).alias("normalized"), F.transform(X.word_tokens(word), F.lower).alias("tokens"), F.array_sort(kinds).alias("types"), state.alias("history"))
    out = out.where(F.size("tokens").between(least, most) & (F.length("canonical") <= longest))
    return out.withColumn("types", F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit("multiword_lexeme")))).withColumn("phrase_id", F.concat(F.lit("phrase:"), F.left(F.sha2(F.col("normalized").cast("binary"), 256), F.lit(24))))


#: What transcripts carry besides speech, in the order of removal; then lines that are dropped.
TRANSCRIPT_NOISE = ((r"^\s*\d{1,5}\s+", ""), (r"(?i)^\s*(?:ME|MO)\s*\d+[A-Z]?\s*[:\-–—]?\s*", ""), (r"^\s*[A-ZÄÖÜ]{1,5}\d{0,3}\s*[:\-–—]\s*", ""), (r"<[^>]{1,100}>", " "), (r"\{[^}]{1,100}\}", " "),
                    (r"\[[^\]]{0,100}\]", " "), (r"(?i)\((?:laughs?|laughter|pause|coughs?|breathes?|unintelligible|unclear|overlap|smiles?|sniffs?|sighs?)[^)]*\)", " "), (r"\(\s*\.{1,3}\s*\)", " "), (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", " "), (r"\s+", " "))
TRANSCRIPT_DROPPED = r"(?i)^\d+$|^transcript(?:ion)?\b|^seite\s+\d+|^page\s+\d+"


def transcript_line(value: Column) -> Column:
    """SR-12: a spoken line without time marks, speaker names and stage directions; null if nothing is left."""
    s = F.trim(F.regexp_replace(value, "­", ""))
    for pattern, put in TRANSCRIPT_NOISE:
        s = F.regexp_replace(s, pattern, put)
    s = F.trim(s)
    return F.when((s != "") & ~s.rlike(TRANSCRIPT_DROPPED), s)


def sentences(rows: DataFrame) -> DataFrame:
    """SR-13/20: id and sentence of ``id<TAB>sentence`` lines, or the line itself without a tab; blanks are dropped."""
    tab = F.instr("value", "\t")
    s = F.trim(F.when(tab > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise(F.col("value")))
    return rows.select(F.when(tab > 0, F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))).alias("id"), s.alias("sentence")).where("sentence != ''")


def assessed_sentences(df: DataFrame, least: int = 3, most: int = 48) -> DataFrame:
    """SR-20: one row per normalised sentence, with why a sentence is not used (null: used)."""
    tokens = X.word_tokens("sentence")
    numbers = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{N}+$")))
    why = F.when(F.col("sentence").rlike(r"(?i)https?://|www\."), "url").when(F.size(tokens) < least, "short").when(F.size(tokens) > most, "long").when(numbers * 4 > F.size(tokens), "digits")
    return df.withColumn("rejected", why).withColumn("identity", F.sha2(F.array_join(F.transform(tokens, F.lower), " ").cast("binary"), 256)).dropDuplicates(["identity"])


#: Section labels, first pattern that matches.
SECTIONS = (("pre_hook", r"pre[- ]?(?:chorus|hook)"), ("post_hook", r"post[- ]?(?:chorus|hook)"), ("hook", r"\b(?:chorus|hook|refrain)\b"), ("verse", r"\b(?:verse|part|strophe)\b"), ("intro", r"\bintro\b"),
            ("outro", r"\boutro\b"), ("bridge", r"\bbridge\b"), ("interlude", r"\b(?:interlude|skit|spoken|drop)\b"))


def section_type(label: Column) -> Column:
    base = F.regexp_replace(F.trim(F.split_part(F.lower(F.trim(label)), F.lit(":"), F.lit(1))), r"\s+\d+$", "")
    out = F.when(F.lower(F.trim(label)).rlike("^(songtext zu|lyrics to)"), "metadata")
    for name, pattern in SECTIONS:
        out = out.when(base.rlike(pattern), name)
    return out.otherwise("other")


def lyrics(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """SR-15, SF-14: lines of lyric texts with song and section numbers, both running counts of headers above a line.

    Songs begin at ``--- name ---``, sections at ``[label]``; links, metadata and rules are dropped, and lines before the
    first song.  A line outside sections has section type null."""
    from pyspark.sql.window import Window

    rows = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).drop("raw")
    is_song, label = F.col("line").rlike(r"^---\s+.+\s+---$"), F.regexp_extract("line", r"^\[([^\]]+)\]$", 1)
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("song", F.sum(F.when(is_song, 1).otherwise(0)).over(above)).withColumn("_label", F.when(label != "", section_type(label)))
    own = Window.partitionBy(key, "song").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.sum(F.when(F.col("_label").isNotNull(), 1).otherwise(0)).over(own)).withColumn("section_type", F.last("_label", ignorenulls=True).over(own))
    noise = F.col("line").rlike(r"(?i)https?://|www\.|^(?:Collected:|Songtext zu\b|Lyrics to\b)|^[#\-=*_~. ]*$")
    kept = marked.where((F.col("song") > 0) & ~is_song & F.col("_label").isNull() & ~noise & (F.size(X.word_tokens("line")) > 0))
    return kept.select(key, "song", F.when(F.col("section_type") != "metadata", F.col("section")).alias("section"), F.nullif("section_type", F.lit("metadata")).alias("section_type"), "line_no", "line",
                       F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{M}\p{N}]+", " ")).alias("normalized"), X.end_word("line").alias("last_word"))


#: Markers of spelling variants, from equal to wrong, and the regions of a lexicon line.
VARIANT_LEVELS = {".": 1, "=": 2, "?": 3, "v": 4, "~": 5, "V": 6, "@": 7, "-": 8, "x": 9}
REGIONS = ("US", "GB", "CA", "AU")


def _outside_brackets(text: str, separator: str) -> list[str]:
    """Parts of a text between separators that stand in no round brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth = max(0, depth + (ch == "(") - (ch == ")"))
        if ch == separator and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def _variants(text: str) -> list[dict] | None:
    """Spelling variants like ``A Bv +``; None if the text is something else."""
    import regex

    out = []
    for token in text.split():
        if regex.fullmatch(r"\{\d+\}", token):
            continue
        m = regex.fullmatch(r"([ABZCD_])([.=?v~V@\-x]?)", token)
        if token != "+" and not m:
            return None
        out.append({"spelling": token[0], "level": VARIANT_LEVELS.get(m[2], 0) if m else 0})
    return out or None


def _plain_word(text: str) -> str:
    import regex

    return regex.sub(r"[*\-@~!†]+$", "", regex.sub(r"^[-@!](?=\p{L})", "", text.strip())).strip()


def lexicon_line(line: str | None) -> dict | None:
    """SR-05: one line ``size [region]: [variants:] lemma <pos/class> {note} (gloss): derived, (A: x | B: y) # comment``."""
    import regex

    raw = (line or "").strip()
    head, sep, rest = raw.partition(": ")
    first = regex.match(r"\s*([+-]?\d+)", head)
    if raw.startswith("#") or not sep or not first:
        return None
    found = regex.search(r"\s+#(?:!|[^:])", rest)
    rest = rest[: found.start()].strip() if found else rest
    before, sep, after = rest.partition(": ")
    variants = (_variants(before) if sep else None) or []
    rest = after if variants else rest
    lemma_text, _, derived_text = rest.partition(": ")
    marked = lambda m: bool(regex.match(rf"{m}(?=\p{{L}})", lemma_text.strip()) or regex.search(rf"{m}(?:\s+<|\s+\{{|\s+\(|$)", lemma_text))
    pos = regex.search(r"\s+<([^>]+)>", lemma_text)
    text = lemma_text[: pos.start()] if pos else regex.sub(r"\s+\([^)]*\)$", "", regex.sub(r"\s+\{[^}]*\}\s*(?:\([^)]*\))?$", "", lemma_text.strip()))
    lemma, derived = _plain_word(text), []
    if not lemma or lemma == "-":
        return None
    for entry in map(str.strip, _outside_brackets(derived_text, ",")):
        choices = _outside_brackets(entry[1:-1], "|") if entry.startswith("(") and entry.endswith(")") else [entry]
        for c in map(str.strip, choices):
            kind, sep, word = c.partition(": ")
            word = _plain_word(word if len(choices) > 1 and sep and _variants(kind) or entry.startswith("(") and sep and _variants(kind) else c)
            derived += [word] if word and word != "-" else []
    tag = pos[1] if pos else None
    return {"size": int(first[1]), "region": next((t for t in head.split() if t in REGIONS), None), "variants": variants, "lemma": lemma, "pos": tag, "pos_class": tag.partition("/")[2] if tag and "/" in tag else None,
            "archaic": marked("@"), "uncommon": marked("-"), "invalid": any(v["level"] >= VARIANT_LEVELS["-"] for v in variants), "derived": derived}


LEXICON_LINE = "size int, region string, variants array<struct<spelling:string,level:int>>, lemma string, pos string, pos_class string, archaic boolean, uncommon boolean, invalid boolean, derived array<string>"


def derivation_lexicon(rows: DataFrame, value: str = "value") -> DataFrame:
    """SR-05: a row per line of a spelling and derivation lexicon; comments and malformed lines are skipped."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("size", pa.int32()), ("region", pa.string()), ("variants", pa.list_(pa.struct([("spelling", pa.string()), ("level", pa.int32())]))), ("lemma", pa.string()), ("pos", pa.string()), ("pos_class", pa.string()),
                           ("archaic", pa.bool_()), ("uncommon", pa.bool_()), ("invalid", pa.bool_()), ("derived", pa.list_(pa.string()))])
        for b in batches:
            yield pa.RecordBatch.from_pylist([r for r in map(lexicon_line, b.column(0).to_pylist()) if r], kinds)

    return rows.select(value).mapInArrow(run, LEXICON_LINE)


def database_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """SR-14: a table of a relational database; with a whole-number key it is read in parts by ranges of the key."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {table}").load().first()
    return reader.option("dbtable", table).option("partitionColumn", key).option("lowerBound", low or 0).option("upperBound", (high or 0) + 1).option("numPartitions", parts).load()


def point_lookup(table: DataFrame, key: str, values: list) -> DataFrame:
    """SR-16: the rows of a few keys; the condition is pushed down, so row groups without them are not read."""
    return table.where(F.col(key).isin(values))
