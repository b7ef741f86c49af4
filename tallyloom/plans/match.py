"""Board models to the identities of an arena: candidates, the automatic choice, review rows and mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import cleaning, identity
from tallyloom.operators.ranking import best_candidate, first_per_key
from tallyloom.session import cut

#: Places that the names without a family are dealt to when all their candidates are listed, as they share one key.
SALTS = 16
#: The least similarity of the best of several candidates.
LEAST = 0.3
#: Words of a name that is found by two words in common; longer ones are found by one.
LONG = 16

NO_MATCH = "NO_MATCH_FOUND"
UNIVERSE_SCORE = 1330.0


def arena_identities(arena: DataFrame, least: float = UNIVERSE_SCORE) -> DataFrame:
    """(pos, lmarena_model, info) of the arena's raw (row_no, model_raw, score_raw) whose score, "Preliminary" or not, reaches `least`."""
    rows = arena.where(cleaning.parse_preliminary_score(F.col("score_raw")) >= least).select(F.col("row_no").alias("pos"), F.col("model_raw").alias("lmarena_model"))
    return rows.join(cut(identity.identities(rows, "lmarena_model")), "lmarena_model")


def candidates(names: DataFrame, arena: DataFrame) -> DataFrame:
    """(benchmark_id, model_name, info, pos, lmarena_model, c_info, similarity): a row with nulls where nothing matches.

    Equal family, subfamily and version, two nulls being equal, are keys of a
    hash join; parameters must be equal unless one side has none.  Names
    without a family all have one key, which is dealt to SALTS places; all
    their candidates are listed, as a review asks: `best_matches` finds the
    automatic choice without the list.
    """
    left = names.join(identity.identities(names, "model_name"), "model_name")
    right = arena.select("pos", "lmarena_model", F.col("info").alias("c_info"))
    version = lambda c: identity.normal_version(F.col(f"{c}.version"))
    keys = F.col("info.family").eqNullSafe(F.col("c_info.family")) & F.col("info.subfamily").eqNullSafe(F.col("c_info.subfamily")) & version("info").eqNullSafe(version("c_info"))
    either = F.col("info.parameters").isNull() | F.col("c_info.parameters").isNull() | (F.lower("info.parameters") == F.lower("c_info.parameters"))
    salt = F.when(F.col("info.family").isNull(), F.pmod(F.xxhash64("model_name"), F.lit(SALTS))).otherwise(0).cast("int")
    places = F.when(F.col("c_info.family").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    joined = left.withColumn("__salt", salt).join(right.withColumn("__place", F.explode(places)), keys & either & (F.col("__salt") == F.col("__place")), "left").drop("__salt", "__place")
    return joined.withColumn("similarity", F.when(F.col("lmarena_model").isNotNull(), identity.similarity(F.col("info"), F.col("c_info"))))


def choose(found: DataFrame) -> DataFrame:
    """(benchmark_id, model_name, lmarena_model) of the automatic choice."""
    return best_candidate(found.where(F.col("lmarena_model").isNotNull()), ["benchmark_id", "model_name"], "similarity", ["pos"]).select("benchmark_id", "model_name", "lmarena_model")


def _signatures(rows: DataFrame, info: str) -> DataFrame:
    """The rows with what their similarity depends on, where there is no family: version, date, parameters and words, and all of that as one text."""
    parts = F.struct(identity.normal_version(F.col(f"{info}.version")).alias("version"), F.col(f"{info}.date").alias("date"), F.lower(f"{info}.parameters").alias("parameters"), F.array_sort(identity.normal_tokens(F.col(f"{info}.other_info"))).alias("words"))
    return rows.withColumn("s", parts).select("*", "s.*", F.to_json("s").alias("signature")).drop("s")


def _share(mine: tuple[bool, bool], theirs: tuple[bool, bool]) -> float:
    """The share of words in common without which names that are (dated, sized) don't reach LEAST; what equal dates or parameters add is left to their own joins."""
    date = 0.1 if mine[0] and theirs[0] else 0.04 if mine[0] or theirs[0] else 0.0
    return 2 * (LEAST - date - (0.06 if mine[1] != theirs[1] else 0.0))


def _by_rarity(sides: DataFrame) -> DataFrame:
    """(id, by_rarity) of (id, words): the words, rarest first."""
    words = sides.select("id", F.explode("words").alias("word"))
    counted = words.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word")
    return counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word")))["word"].alias("by_rarity"))


def _word_keys(side: DataFrame, name: str, pairs_of_kinds: list[tuple[tuple[bool, bool], tuple[bool, bool]]]) -> DataFrame:
    """The rows of a side with a row for each `key` under which another name that has the needed share of its words in common stands too.

    A share J of n words is k = ceil(J n) words or more.  The two rarest that
    two names have in common are among the n - k + 2 rarest of each, and any two
    of those are a key.  Where one word is enough each is a key as well; so it is
    for names that may meet one of more than LONG words, which have no other keys,
    as their pairs of words are many.  `held` is the number of the key's words and
    `rest` how many words come after them.
    """
    place = 0 if name == "m" else 1
    of_kind = lambda values: F.get(F.array(*map(F.lit, values)), F.col("kind"))
    n = F.size("by_rarity")
    rows = side.withColumn("kind", F.explode(F.array(*map(F.lit, range(len(pairs_of_kinds))))))
    rows = rows.where((of_kind([k[place][0] for k in pairs_of_kinds]) == F.col(f"{name}_date").isNotNull()) & (of_kind([k[place][1] for k in pairs_of_kinds]) == F.col(f"{name}_parameters").isNotNull()))
    rows = rows.withColumn("share", of_kind([_share(*k) for k in pairs_of_kinds]))
    rows = rows.withColumn("least", F.greatest(F.ceil(F.col("share") * n - 1e-9), F.lit(1)).cast("int"))
    # a name of whose words one is enough may meet one that needs two
    most = F.least(n, n - F.col("least") + 2)
    rows = rows.select("*", F.posexplode(F.slice("by_rarity", F.lit(1), most)).alias("at", "word"))
    before = F.slice("by_rarity", F.lit(1), F.col("at"))
    none = F.array().cast("array<string>")
    single = ((F.col("least") == 1) | (n > F.col("share") * LONG)) & (F.col("at") <= n - F.col("least"))
    firsts = F.concat(F.when(single, F.array(F.lit(None).cast("string"))).otherwise(none), F.when(n <= LONG, before).otherwise(none))
    rows = rows.withColumn("first", F.explode(firsts))
    return rows.select(*side.columns, F.xxhash64("kind", F.col("first").isNull(), F.coalesce("first", F.lit("")), "word").alias("key"), "share", F.when(F.col("first").isNull(), 1).otherwise(2).alias("held"), (n - F.col("at") - 1).alias("rest")).drop("by_rarity")


def _best_unparsed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(model_name, lmarena_model) of names without a family, by words that two names have in common instead of by all pairs.

    Names of equal signature are one.  A pair that reaches LEAST has a share of
    its words in common, so much as its dates and parameters leave open, and so
    two of the rare ones of each, or an equal date, equal parameters or no words
    on either side; those four are equi-joins.
    """
    names = _signatures(left.select("model_name", "info"), "info")
    first = F.when(F.count("pos") == F.count(F.lit(1)), F.min("pos"))  # a null comes before all
    arena = _signatures(right.groupBy("lmarena_model", "c_info").agg(first.alias("pos"), F.count(F.lit(1)).alias("rows")), "c_info")
    kept = ["signature", "version", "date", "parameters", "words"]
    # ids of the two sides, even and odd, are fixed by the checkpoint
    own = lambda df, odd: cut(df.withColumn("id", F.monotonically_increasing_id() * 2 + odd))
    mine = own(names.groupBy(*kept).agg(F.first("info").alias("info")), 0)
    theirs = own(arena.groupBy(*kept).agg(F.min(F.struct("pos", "lmarena_model", "c_info")).alias("c"), F.sum("rows").alias("rows")), 1)
    m, t = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "version", "date", "parameters", "words")]) for side, df in (("m", mine), ("t", theirs)))
    fit = F.col("m_parameters").isNull() | F.col("t_parameters").isNull() | (F.col("m_parameters") == F.col("t_parameters"))
    same = F.col("m_version").eqNullSafe(F.col("t_version")) & fit
    ordered = cut(_by_rarity(mine.select("id", "words").union(theirs.select("id", "words"))))
    # at most four kinds a side; of two names with parameters these are equal, and `sized` finds them
    present = [[tuple(r) for r in df.select(F.col("date").isNotNull(), F.col("parameters").isNotNull()).distinct().collect()] for df in (mine, theirs)]
    met = [(a, b) for a in present[0] for b in present[1] if not (a[1] and b[1])]
    keyed = lambda df, n: _word_keys(df.join(ordered.withColumnRenamed("id", f"{n}_id"), f"{n}_id"), n, met).withColumnsRenamed({c: f"{n}_{c}" for c in ("rest", "held")})
    in_common = F.size(F.array_intersect("m_words", "t_words"))
    every = F.size("m_words") + F.size("t_words")
    far = F.col("m_held") + F.least("m_rest", "t_rest") >= F.col("share") / (F.col("share") + 1) * every - 1e-9
    alike = in_common >= F.col("share") * (every - in_common) - 1e-9
    apart = [] if not met else [keyed(m, "m").join(keyed(t, "t").drop("share"), "key").where(same & far).where(alike)]
    dated = m.join(t, (F.lower("m_date") == F.lower("t_date")) & same)
    sized = m.join(t, (F.col("m_parameters") == F.col("t_parameters")) & same)
    bare = m.where(F.size("m_words") == 0).join(t.where(F.size("t_words") == 0), same)
    pairs = reduce(DataFrame.union, [x.select("m_id", "t_id") for x in (*apart, dated, sized, bare)]).distinct()
    scored = pairs.join(mine.select(F.col("id").alias("m_id"), "signature", "info"), "m_id").join(theirs.select(F.col("id").alias("t_id"), "c"), "t_id")
    scored = scored.select("signature", F.col("c.pos").alias("pos"), F.col("c.lmarena_model").alias("lmarena_model"), identity.similarity(F.col("info"), F.col("c.c_info")).alias("similarity")).where(F.col("similarity") >= LEAST)
    best = scored.groupBy("signature").agg(F.min(F.struct((-F.col("similarity")).alias("o"), "pos", "lmarena_model")).alias("best")).select("signature", F.col("best.lmarena_model").alias("by_words"))
    # a name's only candidate is taken whatever its similarity: candidates are counted by their parameters, not listed
    kinds = theirs.groupBy("version", "parameters").agg(F.sum("rows").alias("n"), F.min("c").alias("c"))
    every = kinds.groupBy("version").agg(F.sum("n").alias("n"), F.min("c").alias("c")).toDF("e_version", "e_n", "e_c")
    plain = kinds.where(F.col("parameters").isNull()).select("version", "n", "c").toDF("p_version", "p_n", "p_c")
    equal = kinds.where(F.col("parameters").isNotNull()).toDF("q_version", "q_parameters", "q_n", "q_c")
    counted = mine.select("signature", "version", "parameters").join(every, F.col("version").eqNullSafe(F.col("e_version")), "left").join(plain, F.col("version").eqNullSafe(F.col("p_version")), "left").join(equal, F.col("version").eqNullSafe(F.col("q_version")) & (F.col("parameters") == F.col("q_parameters")), "left")
    number = F.when(F.col("parameters").isNull(), F.coalesce("e_n", F.lit(0))).otherwise(F.coalesce("p_n", F.lit(0)) + F.coalesce("q_n", F.lit(0)))
    only = F.when(F.col("parameters").isNull(), F.col("e_c")).otherwise(F.coalesce("p_c", "q_c"))
    alone = counted.where(number == 1).select("signature", only["lmarena_model"].alias("only"))
    chosen = mine.select("signature").join(best, "signature", "left").join(alone, "signature", "left").select("signature", F.coalesce("by_words", "only").alias("lmarena_model"))
    return names.select("model_name", "signature").join(chosen.where(F.col("lmarena_model").isNotNull()), "signature").select("model_name", "lmarena_model")


def best_matches(names: DataFrame, arena: DataFrame) -> DataFrame:
    """(benchmark_id, model_name, lmarena_model) as choose(candidates(names, arena)) gives, without listing the pairs of names that have no family."""
    known = cut(identity.identities(names, "model_name"))
    parsed, unparsed = F.col("info.family").isNotNull() | F.col("info.subfamily").isNotNull(), F.col("info.family").isNull() & F.col("info.subfamily").isNull()
    by_family = choose(candidates(names.join(known.where(parsed).select("model_name"), "model_name", "left_semi"), arena.where(parsed)))
    by_words = names.join(_best_unparsed(known.where(unparsed), arena.where(unparsed).select("pos", "lmarena_model", F.col("info").alias("c_info"))), "model_name")
    return by_family.union(by_words.select("benchmark_id", "model_name", "lmarena_model"))


def best_of_kinds(rows: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(key, c_key, similarity) of each row's best match among the other rows, the least key of equals; rows: an identity's columns, other_info normalised.

    `keys` are equal, two nulls included, and parameters too unless one side
    has none.  Rows of one identity are one kind and similarity is worked out
    between kinds, so copies add no pairs; a kind's other rows are judged by
    its own least key or, for the row that has it, the next one.  Keys have to
    be unique.
    """
    rows = rows.where(F.col(key).isNotNull()).withColumn("info", F.struct("subfamily", "date", "parameters", F.array_sort("other_info").alias("other_info")))
    rows = rows.select(key, *keys, "info", F.lower("parameters").alias("soft"), F.to_json(F.struct(*keys, "info")).alias("kind"))
    least = rows.groupBy("kind").agg(F.min(key).alias("least"))
    kinds = rows.join(least, "kind").groupBy("kind", *keys, "info", "soft").agg(F.first("least").alias("least"), F.min(F.when(F.col(key) > F.col("least"), F.col(key))).alias("next"), F.count(F.lit(1)).alias("rows"))
    kinds = cut(kinds)
    mine = kinds.select("kind", *keys, "info", "soft", F.pmod(F.xxhash64("kind"), F.lit(SALTS)).cast("int").alias("__salt"))
    theirs = kinds.select(*[F.col(c).alias(f"c_{c}") for c in kinds.columns]).withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in keys], F.col("__salt") == F.col("__place"))
    either = F.col("soft").isNull() | F.col("c_soft").isNull() | (F.col("soft") == F.col("c_soft"))
    alike = lambda b: F.round(identity.similarity(F.col("info"), F.col(b), True), 10)
    pairs = mine.join(theirs, on & either & (F.col("kind") != F.col("c_kind"))).select("kind", "c_rows", F.struct((-alike("c_info")).alias("o"), F.col("c_least").alias("c_key")).alias("place"))
    others = pairs.groupBy("kind").agg(F.min("place").alias("other"), F.sum("c_rows").alias("others"))
    known = kinds.select("kind", "least", "next", "rows", (-alike("info")).alias("own")).join(others, "kind", "left")
    beside = F.when(F.col("rows") > 1, F.struct(F.col("own").alias("o"), F.when(F.col(key) == F.col("least"), F.col("next")).otherwise(F.col("least")).alias("c_key")))
    found = rows.select(key, "kind").join(known, "kind").withColumns({"best": F.least("other", beside), "several": F.coalesce("others", F.lit(0)) + F.col("rows") - 1})
    return found.where((F.col("several") == 1) | (F.col("best.o") <= -LEAST)).select(key, F.col("best.c_key").alias("c_key"), (-F.col("best.o")).alias("similarity"))


def review(found: DataFrame) -> DataFrame:
    """A review row for each model: its identity, the candidates in arena order, untrusted = 1 and the choice, "0" where there is none."""
    one = F.struct("pos", "lmarena_model", F.col("c_info").alias("info"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("lmarena_model").isNotNull(), one))), lambda s: F.struct(s["lmarena_model"].alias("lmarena_model"), s["info"].alias("info")))
    rows = found.groupBy("benchmark_id", "model_name").agg(F.first("info").alias("benchmark_info"), listed.alias("candidates"))
    none = F.array(F.struct(F.lit(NO_MATCH).alias("lmarena_model"), F.lit(None).cast(identity.IDENTITY).alias("info")))
    rows = rows.withColumn("candidates", F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(none))
    return rows.join(choose(found), ["benchmark_id", "model_name"], "left").select("benchmark_id", "model_name", "benchmark_info", "candidates", F.lit(1).alias("untrusted"), F.coalesce("lmarena_model", F.lit("0")).alias("selected"))


def statistics(found: DataFrame) -> DataFrame:
    """matched, unmatched and several-candidate models of each benchmark."""
    return statistics_of_counts(found.groupBy("benchmark_id", "model_name").agg(F.count("lmarena_model").alias("n")))


def statistics_of_counts(counts: DataFrame) -> DataFrame:
    """The same of (benchmark_id, model_name, n), n being how many candidates a model has."""
    return counts.groupBy("benchmark_id").agg(F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n") == 0).alias("unmatched"), F.count_if(F.col("n") > 1).alias("several"))


def selected_text(value: str = "value") -> Column:
    """The reviewed choice in a variant document entry: a text that isn't blank, else null."""
    picked = f"variant_get({value}, '$.selected_lmarena_model')"
    return F.expr(f"case when schema_of_variant({picked}) = 'STRING' and trim(cast({picked} as string)) <> '' then cast({picked} as string) end")


def mapping(reviewed: DataFrame) -> DataFrame:
    """(benchmark_id, model_name, model_id) of reviewed (benchmark_id, pos, model_name, selected): the first model in document order for each id."""
    rows = reviewed.where(F.col("selected").isNotNull() & ~F.trim("selected").isin("", "0", "-1"))
    return first_per_key(rows, ["benchmark_id", "selected"], ["pos"]).select("benchmark_id", "model_name", F.col("selected").alias("model_id"))
