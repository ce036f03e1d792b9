"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

Base spans (email, ip, card, phone) come from regular expressions with checks. They are the seeds, together with secret-like
strings (RUN, STRONG: long runs of letters and digits). Around each seed stand lexical patterns, compared without case:

* L: the two words before, * B: the word before and the word behind, * S: the word before and the value's shape,
* K: what the value's own token has before it up to its last `=` or `:`.

Marks that touch the value (quotes, brackets) belong to its pattern. Patterns around SUPPORT different seeds are looked up in
all tokens of all texts; any token there, whatever it looks like, is an instance. Patterns of common words, whose counts over
all texts (sketches of 5 % error, with a margin) show that they can't be accepted, are left out first; should more values be
trusted than that allows, they are looked up after all, so that results stay as they were without this step. Patterns and instances (values) form a graph.
In each of ROUNDS rounds a pattern's confidence is the share of trusted values among its values (with one doubtful value
added), patterns with enough support and confidence are accepted, and a value is trusted by the chance that not all of its
accepted patterns err. Values that come to be trusted so are seeds of another cycle, up to CYCLES or until there is none. At
the end each token whose own accepted patterns give TRUST, and that touches no base span, becomes a span of kind `id`.

The regular expressions below find what the contract's find, without its backtracking: possessive loops, and starts only
where a match can begin. Offsets are code points: match and gap lengths add up.

Defined cases: a null text is empty; documents with equal id and text get equal spans; null ids are kept; an empty table
gives an empty result. Pairs of pattern and value count once, so groups of copies weigh no more than one document. Words are
what single white-space characters part; a context with two of them in a row has no word there. The context of a seed is
cut at CONTEXT characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A whole run of digits, single spaces and hyphens between them, of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Secret-like strings: whole runs of letters, digits and underscores, of them those with three digits and a letter.
RUN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"
STRONG = "^(?=(?:[A-Za-z_]*[0-9]){3})(?=[0-9_]*[A-Za-z])"
#: What a token has before its value: up to the last = or :, and marks.
AFFIX = r"^(?:.*[=:])?[^\p{L}\p{N}+]*"
MARKS = r"[^\p{L}\p{N}]*$"
LETTERS = r"^\p{L}+$"
CONTEXT, CYCLES = 200, 3
#: The words and marks of a context; a pattern has one value of those that it is made of.
CONTEXT_OF = ("p2", "p1", "nx", "prefix")

ROUNDS, SUPPORT, CONFIDENCE, TRUST = 3, 5.0, 0.8, 0.9
#: Values of letters only from which a pattern may be left out of a look-up, where its counts show that it can't be accepted.
WIDE = 1000
#: Rows (patterns, context words, values, documents with added spans; some 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000

SPAN = "struct<start:int,rank:int,end:int>"


def located(df: DataFrame, name: str, regex: str, needs: Column) -> DataFrame:
    """df with column name: array of (start, end, value) of the matches of regex in _text; needs: false where there can't be any."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(needs, F.regexp_extract_all("_text", F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", regex, -1)).otherwise(none))
    return df.withColumn(
        name,
        F.expr("""
          aggregate(arrays_zip(_m, slice(_p, 1, size(_m))),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>)),
            (a, x) -> named_struct('at', a.at + length(x.`1`) + length(x._m),
              'out', concat(a.out, array(named_struct('start', a.at + length(x.`1`), 'end', a.at + length(x.`1`) + length(x._m), 'value', x._m)))),
            a -> a.out)"""),
    )


DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0L, (a, i) -> a + IF(i % 2 = 0, (2 * cast(substring({DIGITS}, -i, 1) as int)) div 10 + (2 * cast(substring({DIGITS}, -i, 1) as int)) % 10, cast(substring({DIGITS}, -i, 1) as int))) % 10 = 0"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, base spans and written strings with their contexts, from one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.xxhash64(text).alias("tkey"), text.alias("_text"))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    df = located(df, "_email", EMAIL, F.contains("_text", F.lit("@")))
    df = located(df, "_ip", IP, F.col("_digit") & F.contains("_text", F.lit(".")))
    df = located(df, "_card", CARD, F.col("_digit"))
    df = located(df, "_phone", PHONE, F.col("_digit") & F.contains("_text", F.lit("+")))
    df = df.withColumn("_ip", F.expr(f"filter(_ip, x -> x.value rlike r'^{IP_PART}(?:\\.{IP_PART}){{3}}$')"))
    df = df.withColumn("_card", F.expr(f"filter(_card, x -> {LUHN})"))
    df = df.withColumn("_phone", F.expr(f"filter(_phone, x -> length({DIGITS}) between 10 and 15)"))
    base = F.concat(*(F.expr(f"transform(_{k}, x -> named_struct('start', x.start, 'rank', {n}, 'end', x.end))") for n, k in enumerate(KINDS)))
    df = df.withColumn("base", F.array_sort(base))
    df = located(df, "_strong", RUN, F.col("_digit"))
    df = df.withColumn("_strong", F.expr(f"filter(_strong, x -> x.value rlike r'{STRONG}')"))
    around = F.expr(f"""
      transform(concat(transform(base, s -> named_struct('start', s.start, 'end', s.end)), transform(_strong, s -> named_struct('start', s.start, 'end', s.end))),
        s -> named_struct('value', lower(substring(_text, s.start + 1, s.end - s.start)),
          'b', lower(substring(_text, greatest(s.start - {CONTEXT - 1}, 1), least(s.start, {CONTEXT}))), 'a', lower(substring(_text, s.end + 1, {CONTEXT}))))""")
    seeds = F.expr(r"""
      transform(_around, s -> named_struct('value', s.value, 'prefix', regexp_extract(s.b, r'(\S*)$', 1), 'p1', regexp_extract(s.b, r'(\S+)\s\S*$', 1),
        'p2', regexp_extract(s.b, r'(\S+)\s\S+\s\S*$', 1), 'suffix', regexp_extract(s.a, r'^(\S*)', 1), 'nx', regexp_extract(s.a, r'^\S*\s(\S+)', 1)))""")
    return df.withColumn("_around", around).select("doc_id", "tkey", "base", seeds.alias("seeds"))


def shape(value: Column) -> Column:
    """Runs of letters as one, digits by their number; a long hexadecimal string by its length only."""
    hexadecimal = value.rlike("^[0-9a-fA-F]{16,}$") & value.rlike("[a-fA-F]")
    return F.when(hexadecimal, F.concat(F.lit("hex"), F.length(value).cast("string"))).otherwise(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a"))


def patterns(w: Column) -> Column:
    """The patterns of an occurrence (value, prefix, p1, p2, suffix, nx, all in lower case); those without their words are left out."""
    every = F.array(
        F.when((w["p1"] != "") & (w["p2"] != ""), F.concat_ws(" ", F.lit("L"), w["p2"], w["p1"], w["prefix"])),
        F.when((w["p1"] != "") & (w["nx"] != ""), F.concat_ws(" ", F.lit("B"), w["p1"], w["prefix"], F.lit("_"), w["suffix"], w["nx"])),
        F.when(w["p1"] != "", F.concat_ws(" ", F.lit("S"), w["p1"], w["prefix"], shape(w["value"]))),
        F.when(w["prefix"].rlike(r"[\p{L}\p{N}]"), F.concat_ws(" ", F.lit("K"), w["prefix"])),
    )
    return F.filter(every, lambda p: p.isNotNull())


def hinted(df: DataFrame, small: DataFrame | None = None) -> DataFrame:
    """df, to be broadcast if it (or the table it comes from) has few rows."""
    return F.broadcast(df) if (small or df).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tokens(docs: DataFrame, masked: bool) -> DataFrame:
    """doc_id, tkey, place of each token, the word before, and the tokens of its text (_low: in lower case; _own: as they are, where lengths differ). masked: without what spans of several tokens hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tkey = F.xxhash64(text)
    if masked:
        text = F.when(text.rlike("[0-9][ )(-]+[0-9]"), F.regexp_replace(F.regexp_replace(text, PHONE, "\x01"), CARD, "\x01")).otherwise(text)
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))  # so that the split needs no expression
    rows = docs.select("doc_id", tkey.alias("tkey"), text.alias("_text"), F.lower(text).alias("_lower"))
    # Lower case never has fewer characters: where it has as many, it has them in the same places.
    own = F.when(F.length("_text") != F.length("_lower"), F.split("_text", " ", -1))
    rows = rows.select("doc_id", "tkey", own.alias("_own"), F.split("_lower", " ", -1).alias("_low"))
    return rows.select("doc_id", "tkey", "_own", "_low", F.posexplode(F.concat(F.array(F.lit("")), "_low")).alias("place", "p1")).where(F.get("_low", F.col("place")) != "")


def spelled(rows: DataFrame) -> DataFrame:
    """doc_id, tkey, place, token and neighbours in lower case of rows of tokens(). The token is so, too, where that keeps its length."""
    at = lambda tokens, ahead: F.coalesce(F.get(tokens, F.col("place") + ahead), F.lit(""))
    return rows.select("doc_id", "tkey", "place", at(F.coalesce("_own", "_low"), 0).alias("token"), "p1", at("_low", -2).alias("p2"), at("_low", 1).alias("nx"))


def occurrences(found: DataFrame, *more: str) -> DataFrame:
    """found (token and its neighbours) with the columns of patterns(), and the lengths of prefix and value."""
    # Each step is a generated column: it is computed once a token, however often the next ones use it.
    once = lambda df, name, value: df.select("*", F.explode_outer(F.array(value)).alias(name))
    out = once(found, "_prefix", F.regexp_extract("token", AFFIX, 0))
    rest = F.substring(F.col("token"), F.length("_prefix") + 1, F.length("token"))
    out = once(out, "_value", F.regexp_replace(rest, MARKS, "")).where("_value <> ''")
    suffix = F.substring(rest, F.length("_value") + 1, F.length("token"))
    out = once(out, "w", F.struct(F.lower("_value").alias("value"), F.lower("_prefix").alias("prefix"), "p1", "p2", F.lower(suffix).alias("suffix"), "nx"))
    return out.select(*more, F.length("_prefix").alias("before"), F.length("_value").alias("long"), "w")


def hits(rows: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """Tokens and neighbours of those rows of tokens() that stand in contexts of known (materialised) patterns of kinds; hashes _L, _B, ... tell which.

    Hashes of the words of a context rule nearly all tokens out, before any expression is matched. While the known words are
    few, the word before does so before a token becomes a row of its own; beyond that, token and neighbours are shuffled.
    """
    kind = F.substring("pattern", 1, 1)
    sets = {"L": F.xxhash64("p2", "p1"), "B": F.xxhash64("p1", "nx"), "S": F.xxhash64("p1"), "K": F.xxhash64("prefix")}
    bare = "S" in kinds and known.where((kind == "S") & ~F.col("pattern").rlike("[9@]|hex")).limit(1).count() > 0  # a shape of letters only
    likely = F.lit(True) if bare else F.col("token").rlike("[0-9@]")
    key = F.when(F.contains("token", F.lit("=")) | F.contains("token", F.lit(":")), F.lower(F.regexp_extract("token", AFFIX, 0)))
    asked = {"L": F.xxhash64("p2", "p1"), "B": F.xxhash64("p1", "nx"), "S": F.when(likely, F.xxhash64("p1")), "K": F.when(key.isNotNull(), F.xxhash64(key))}
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first = known.where(kind.isin(kinds) & (kind != "K")).select(F.xxhash64("p1").alias("_first")).distinct()
        near = rows.join(F.broadcast(first), F.xxhash64("p1") == F.col("_first"), "left")
        keyed = F.contains(F.get("_low", F.col("place")), F.lit("=")) | F.contains(F.get("_low", F.col("place")), F.lit(":"))
        rows = near.where(F.col("_first").isNotNull() | keyed if "K" in kinds else F.col("_first").isNotNull())
    near = spelled(rows)
    for k in kinds:
        near = near.join(hinted(known.where(kind == k).select(sets[k].alias(f"_{k}")).distinct(), known), asked[k] == F.col(f"_{k}"), "left")
    hit = F.coalesce(*(F.col(f"_{k}") for k in kinds)).isNotNull()
    # The token depends on the joins, so filters on its parts can't be pushed before them.
    return near.where(hit).withColumn("token", F.when(hit, F.col("token")))


def inside(rows: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Occurrences of tokens (rows of tokens()) in known patterns (pattern, p1, p2, nx, prefix): more, before, long, w, pattern."""
    known = materialise(known, "known")
    kinds = [r[0] for r in known.select(F.substring("pattern", 1, 1)).distinct().collect()]  # L, B, S, K
    if not kinds:
        return occurrences(spelled(rows), *more).select("*", F.lit("").alias("pattern")).limit(0)
    every = occurrences(hits(rows, known, kinds), *more).select("*", F.explode(patterns(F.col("w"))).alias("pattern"))
    return every.join(hinted(known.select("pattern").distinct(), known), "pattern")


def hopeless(docs: DataFrame, known: DataFrame, confidence: float = CONFIDENCE, least: int = WIDE) -> DataFrame:
    """Those of known patterns (materialised, n: seeds) that can't be accepted, and spare: while no more values of letters only than that are trusted.

    A pattern is accepted only if (1 - confidence) * trusted >= confidence * (doubtful + 1). Tokens of letters only are values
    as they stand; a count of different ones bounds the doubtful values from below, a count of other tokens the trusted ones
    from above. The counts are sketches, so no value is kept; each is taken as 1.25 times off, some five times its error.
    """
    bare = known.where((F.col("pattern") == F.concat_ws(" ", F.lit("L"), "p2", "p1", F.lit(""))) | (F.col("pattern") == F.concat_ws(" ", F.lit("B"), "p1", F.lit(""), F.lit("_"), F.lit(""), "nx")))
    bare = materialise(bare, "bare")
    kinds = [r[0] for r in bare.select(F.substring("pattern", 1, 1)).distinct().collect()]  # L, B
    if not kinds:
        return bare.select("pattern", F.lit(0.0).alias("spare")).limit(0)
    near = hits(tokens(docs, True), bare, kinds)
    letters = F.col("token").rlike(LETTERS)
    near = near.select(*(f"_{k}" for k in kinds), F.when(letters, F.lower("token")).alias("word"), F.when(~letters, F.lower("token")).alias("other"))
    sums = near.groupingSets([[F.col(f"_{k}")] for k in kinds], *(F.col(f"_{k}") for k in kinds)).agg(F.approx_count_distinct("word", 0.05).alias("words"), F.approx_count_distinct("other", 0.05).alias("others"))
    sums = materialise(sums, "counts")
    words = {"L": ("p2", "p1"), "B": ("p1", "nx")}
    out = None
    for k in kinds:
        counts = sums.where(F.col(f"_{k}").isNotNull()).select(F.col(f"_{k}").alias("_k"), (F.col("words") / 1.25).alias("doubtful"), (F.col("others") * 1.25).alias("others"))
        one = bare.where(F.substring("pattern", 1, 1) == k).withColumn("_k", F.xxhash64(*words[k])).join(counts, "_k")
        one = one.withColumn("spare", F.col("doubtful") / 4)
        one = one.where((F.col("doubtful") >= least) & ((1 - confidence) * (F.col("others") + F.col("n") + F.col("spare")) < confidence * (F.col("doubtful") - F.col("spare"))))
        one = one.select("pattern", "spare")
        out = one if out is None else out.unionByName(one)
    return out


def accepted(edges: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE, trust: float = TRUST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted patterns (pattern, confidence), trusted values that aren't seeds, and all values trusted in any round, from edges (pattern, value, seed), one row a pair."""
    scored, ever = edges.withColumn("score", F.col("seed").cast("double")), None
    for _ in range(rounds):
        sums = scored.groupBy("pattern").agg(F.sum("score").alias("trusted"), F.count("*").alias("n"))
        good = materialise(sums.withColumn("confidence", F.col("trusted") / (F.col("n") + 1)).where((F.col("trusted") >= support) & (F.col("confidence") >= confidence)).select("pattern", "confidence"), "patterns")
        chances = edges.join(hinted(good), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("chance"))
        score = F.when(F.col("seed"), 1.0).when(F.col("chance") >= trust, F.col("chance")).otherwise(0.0)
        scored = edges.join(chances, "value", "left").withColumn("score", score).drop("chance")
        sure = chances.where(F.col("chance") >= trust).select("value")
        ever = sure if ever is None else ever.unionByName(sure)
    return good, chances.where(F.col("chance") >= trust).select("value").join(edges.where("seed").select("value").distinct(), "value", "left_anti"), ever.distinct()


def learned(docs: DataFrame, rows: DataFrame, cycles: int = CYCLES, support: float = SUPPORT, wide: int = WIDE, **options) -> DataFrame | None:
    """Accepted patterns (pattern, their words, confidence) of docs, from the seeds of rows (as of scanned()); None where no seeds share one."""
    seeds = rows.where(F.size("seeds") > 0).select(F.explode("seeds").alias("w")).distinct()
    seeds = materialise(seeds.select(F.explode(patterns(F.col("w"))).alias("pattern"), *(F.col(f"w.{c}") for c in CONTEXT_OF), "w.value").distinct(), "seeds")
    out = None
    for cycle in range(cycles):
        enough = seeds.groupBy("pattern").agg(F.countDistinct("value").alias("n"), *(F.min(c).alias(c) for c in CONTEXT_OF)).where(F.col("n") >= support)
        enough = materialise(enough, "enough")
        if not enough.take(1):
            return out
        # A value that is a seed anywhere is one in all its patterns.
        sure = seeds.select("value").distinct().withColumn("sure", F.lit(True))
        vain = materialise(hopeless(docs, enough, options.get("confidence", CONFIDENCE), wide), "hopeless")
        while True:
            asked = enough.join(hinted(vain.select("pattern"), vain), "pattern", "left_anti")
            seen = inside(tokens(docs, True), asked).select("pattern", F.col("w.value").alias("value"), F.lit(False).alias("seed"))
            edges = seen.unionByName(seeds.join(hinted(asked.select("pattern"), enough), "pattern").select("pattern", "value", F.lit(True).alias("seed")))
            edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
            edges = materialise(edges.join(hinted(sure, seeds), "value", "left").select("pattern", "value", (F.col("seed") | F.coalesce("sure", F.lit(False))).alias("seed")), "edges")
            good, new, ever = accepted(edges, support=support, **options)
            if not vain.take(1):
                break
            trusted = ever.unionByName(sure.select("value")).where(F.col("value").rlike(LETTERS)).distinct().count()
            if not vain.where(F.col("spare") < trusted).take(1):
                break
            vain = materialise(vain.where(F.col("spare") >= trusted), "hopeless")
        out = materialise(good.join(enough, "pattern"), "accepted")
        new = materialise(new, "new")
        if cycle + 1 == cycles or not new.take(1):
            return out
        bare = spelled(tokens(docs, True)).withColumn("value", F.lower(F.btrim("token", F.lit("\"'()[]{}<>,.;!?"))))
        bare = bare.withColumn("value", F.when(F.col("value").rlike("[=:]"), F.regexp_replace("value", "^.*[=:]", "")).otherwise(F.col("value")))
        found = occurrences(bare.join(hinted(new), "value")).select(F.explode(patterns(F.col("w"))).alias("pattern"), *(F.col(f"w.{c}") for c in CONTEXT_OF), "w.value")
        seeds = materialise(seeds.unionByName(found.join(hinted(new), "value").select(*seeds.columns)).distinct(), "seeds")
    return out


def discovered(docs: DataFrame, rows: DataFrame, **options) -> DataFrame | None:
    """doc_id, tkey and added: spans of tokens in accepted patterns."""
    trust = options.get("trust", TRUST)
    good = learned(docs, rows, **options)
    if good is None or not good.take(1):
        return None
    found = inside(tokens(docs, False), good.select("pattern", *CONTEXT_OF), "doc_id", "tkey", "place").drop("w").distinct()
    per = found.join(hinted(good.select("pattern", "confidence"), good), "pattern").groupBy("doc_id", "tkey", "place", "before", "long")
    sure = per.agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("chance")).where(F.col("chance") >= trust)
    places = materialise(sure.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(F.collect_list(F.struct("place", "before", "long")).alias("places")), "places")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("tkey"), text.alias("_text"))
    hit = texts.join(hinted(places), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")))
    span = F.expr(rf"""
      transform(places, p -> named_struct('start', IF(p.place = 0, 0, length(array_join(slice(_tokens, 1, p.place), ' ')) + 1) + p.before, 'rank', {len(KINDS)}, 'long', p.long))""")
    added = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] + s["long"]).alias("end")))
    return hit.withColumn("_tokens", F.split("_text", r"\s", -1)).withColumn("_spans", span).select("doc_id", "tkey", added.alias("added")).distinct()


def written_out(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "id")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """For each row of docs: doc_id, tkey (hash of its text), base (spans: start, rank of kind, end) and added spans.

    options: rounds, cycles, support, confidence and trust of the bootstrap; wide changes its plan only.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(scanned(docs), "scanned")
    none = F.array().cast(f"array<{SPAN}>")
    more = discovered(docs, rows, **options)
    if more is None:
        return rows.select("doc_id", "tkey", "base", none.alias("added"))
    more = materialise(more.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), "added"), "added")
    out = rows.join(hinted(more), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left")
    apart = F.expr("filter(added, x -> not exists(base, b -> b.start < x.end and x.start < b.end))")
    return out.select("doc_id", "tkey", "base", F.coalesce(apart, none).alias("added"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs' doc_id and text with every span replaced by its kind in brackets (of overlapping spans, the union by the first)."""
    rows = personal_data(docs, **options).select(F.col("doc_id").alias("_d"), "tkey", F.array_sort(F.concat("base", "added")).alias("spans")).distinct()
    names = F.array(*(F.lit(k) for k in (*KINDS, "id")))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(rows, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("tkey"))).withColumn("names", names)
    return df.select("doc_id", F.expr("""
      aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, s) -> IF(s.end <= a.at, a, named_struct('at', s.end, 'out', concat(a.out, IF(s.start < a.at, '', concat(substring(text, a.at + 1, s.start - a.at), '[', names[s.rank], ']'))))),
        a -> concat(a.out, substring(text, a.at + 1, length(text))))""").alias("text"))  # fmt: skip
