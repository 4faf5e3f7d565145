"""Two-tier entity resolution of classes: by security code, then by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import labels as L
from tallyframe.functions import scalars as S
from tallyframe.functions.predicates import amount_difference

#: Fields of a class row that are compared with stored facts; the rate rescales.
FACTS = ["interest_rate", "interest_payment", "principal_payment", "deferred_interest", "beginning_balance", "ending_balance"]


def first_code(candidates: DataFrame, codes: DataFrame, key: list[str]) -> DataFrame:
    """Tier 1: the first code in order with exactly one id wins; else any with several is ambiguous.

    ``candidates``: key columns, ``pos``, ``code``. ``codes``: ``deal_key`` and
    ``code`` to ``tranche_id``. Returns the keys with ``status`` (ok,
    ambiguous, or null for a miss), ``tranche_id`` and ``matched_code``.
    """
    ids = codes.groupBy("deal_key", "code").agg(F.count_distinct("tranche_id").alias("n"), F.min("tranche_id").alias("id"))
    d = candidates.join(ids, ["deal_key", "code"], "left")
    one, many = F.when(F.col("n") == 1, F.col("pos")), F.col("n") > 1
    g = d.groupBy(*key).agg(F.min_by(F.struct("id", "code"), one).alias("hit"), F.coalesce(F.bool_or(many), F.lit(False)).alias("many"))
    return g.select(*key, F.when(F.col("hit.id").isNotNull(), "ok").when(F.col("many"), "ambiguous").alias("status"), F.col("hit.id").alias("tranche_id"), F.when(F.col("hit.id").isNotNull(), F.col("hit.code")).alias("matched_code"))


def master_rows(classes: DataFrame, master: DataFrame, order: str | None = None) -> DataFrame:
    """Classes (``deal_key, tranche_id``) with their row of the master table as ``master``, and ``master_id``.

    Ids are compared without spaces at the ends. Without an id or a row the
    struct is null and the id empty; of several rows of an id the last in
    ``order`` counts (the greatest row without one).
    """
    row = F.struct(*[F.col(c) for c in master.columns])
    d = master.select(S.strip(F.col("deal_key").cast("string")).alias("__d"), S.strip(F.col("tranche_id").cast("string")).alias("__t"), row.alias("master"), F.struct(*([F.col(order)] if order else []), row).alias("__o"))
    d = d.filter("__t <> ''").groupBy("__d", "__t").agg(F.max_by("master", "__o").alias("master"), F.first("__t").alias("master_id"))
    d = classes.withColumns({"__d": S.strip(F.col("deal_key").cast("string")), "__t": S.strip(F.col("tranche_id").cast("string"))}).join(d, ["__d", "__t"], "left").drop("__d", "__t")
    return d.withColumn("master_id", F.coalesce("master_id", F.lit("")))


def first_variant(variants: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Tier 2: the first variant with any registered name decides.

    One id is ok; several are ambiguous, except that subordinated keys prefer
    a sole ``PS``/``PS1`` row, then a sole ``SUB`` row.
    ``variants``: key columns, ``pos``, ``variant``, ``norm``. ``names``:
    ``deal_key``, ``variant``, ``name``, ``tranche_id``.
    """
    d = variants.join(names.distinct(), ["deal_key", "variant"])
    compact = S.name_key(F.col("name"))
    d = d.withColumns({"is_ps": compact.isin("PS", "PS1"), "is_sub": (compact == "SUB") | L.sub_key(F.upper(F.trim("name"))).isNotNull()})
    g = d.groupBy(*key, "norm", "pos").agg(
        F.count_distinct("tranche_id").alias("n"), F.min(F.struct("name", "tranche_id")).alias("any"), F.count_if("is_ps").alias("n_ps"), F.count_if("is_sub").alias("n_sub"),
        F.min(F.when(F.col("is_ps"), F.struct("name", "tranche_id"))).alias("ps"), F.min(F.when(F.col("is_sub"), F.struct("name", "tranche_id"))).alias("sub"),
    )
    g = g.groupBy(*key, "norm").agg(F.min_by(F.struct("n", "any", "n_ps", "n_sub", "ps", "sub"), "pos").alias("v"))
    collides = F.col("norm").isin("SUB", "PS", "PS1") | F.col("norm").rlike("^(?:SUB|PS)[A-Z]$")
    hit = F.when(F.col("v.n") == 1, F.col("v.any")).when(collides & (F.col("v.n_ps") == 1), F.col("v.ps")).when(collides & (F.col("v.n_sub") == 1), F.col("v.sub"))
    return g.withColumn("hit", hit).select(*key, F.when(F.col("hit").isNotNull(), "ok").otherwise("ambiguous").alias("status"), F.col("hit.tranche_id").alias("tranche_id"), F.col("hit.name").alias("matched_name"))


def deal_context(names: DataFrame) -> DataFrame:
    """``deal_key, has_sub, income_as_ps`` from the registered names of each deal."""
    raw, key = F.upper(F.trim("name")), S.name_key(F.col("name"))
    sub = L.sub_key(raw).isNotNull() | L.tier_key(raw).isNotNull() | key.isin("PS1", "PS2", "PREF", "SUB") | key.rlike("^(?:SUB|PS)[A-Z]$")
    income = key.isin("INC", "INCOME") | L.income_key(raw).isNotNull()
    equity = sub | L.is_preferred(raw)
    g = names.groupBy("deal_key").agg(F.bool_or(sub).alias("has_sub"), F.bool_or(income).alias("income"), F.bool_or(equity).alias("equity"))
    return g.select("deal_key", "has_sub", (~F.col("income") & ~F.col("equity")).alias("income_as_ps"))


def keyed_names(names: DataFrame, context: DataFrame) -> DataFrame:
    """Registered names under every key that may find them."""
    d = names.join(context, "deal_key")
    key = L.class_key(F.col("name"), F.lit(None).cast("string"), F.lit(0), F.col("has_sub"))
    d = d.withColumn("key", key).filter(~F.col("key").rlike(L.JUNK) & (F.col("key") != ""))
    series = F.when(F.col("key").rlike(r"^SERIES\d+$"), L.lookup_variants(F.col("key"), F.lit(False))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(F.col("key"), L.full_preferred_key(F.col("name"))), series)))
    return d.select("deal_key", F.explode(keys).alias("variant"), "name", "tranche_id")


def resolve(classes: DataFrame, codes: DataFrame, names: DataFrame) -> DataFrame:
    """Resolve ``classes(deal_key, class, deal_name, codes array)`` to tranche ids.

    Adds ``tranche_id, tier, status, matched_code, matched_name``. An
    ambiguous code ends the search; a missed one falls through to names.
    Names of a deal are keyed once and joined by key.
    """
    key = ["deal_key", "class"]
    peers = classes.groupBy("deal_key").agg(F.collect_set("class").alias("peers"))
    peers = peers.select("deal_key", L.shared_tokens(F.col("peers")).alias("shared"))
    context = deal_context(names)
    d = classes.join(peers, "deal_key", "left").join(context, "deal_key", "left")
    norm = L.class_key(F.col("class"), F.col("deal_name"), F.coalesce("shared", F.lit(0)), F.coalesce("has_sub", F.lit(True)))
    cands = F.array_distinct(F.array_compact(F.transform(F.coalesce("codes", F.array().cast("array<string>")), S.security_id)))
    d = d.withColumns({"norm": norm, "cands": cands})
    tier1 = first_code(d.select(*key, F.posexplode("cands").alias("pos", "code")), codes.select("deal_key", S.security_id(F.col("code")).alias("code"), "tranche_id"), key)
    variants = d.select(*key, "norm", F.posexplode(L.lookup_variants(F.col("norm"), F.coalesce("income_as_ps", F.lit(False)))).alias("pos", "variant"))
    tier2 = first_variant(variants, keyed_names(names, context), key)
    a = tier1.select(*key, F.col("status").alias("s1"), F.col("tranche_id").alias("id1"), "matched_code")
    b = tier2.select(*key, F.col("status").alias("s2"), F.col("tranche_id").alias("id2"), "matched_name")
    d = d.join(a, key, "left").join(b, key, "left")
    tried, named = F.size("cands") > 0, F.col("s2") == "ok"
    tier = F.when(F.col("s1").isNotNull(), "cusip").when(named, F.when(tried, "cusip+name").otherwise("name")).when(tried, "cusip").when(F.col("norm") != "", "name")
    status = F.when(F.col("s1").isNotNull(), F.col("s1")).when(named, "ok").when(tried, "unmapped").otherwise(F.coalesce("s2", F.lit("unmapped")))
    id_ = F.when(F.col("s1").isNotNull(), F.col("id1")).when(named, F.col("id2"))
    return d.select(*key, "norm", id_.alias("tranche_id"), tier.alias("tier"), status.alias("status"), "matched_code", F.when(F.col("s1").isNull(), F.col("matched_name")).alias("matched_name"))


def fact_rows(resolved: DataFrame, names: DataFrame, facts: DataFrame) -> DataFrame:
    """Period facts of each resolved class: the shortest registered name present wins, then the id itself."""
    own = resolved.filter("tranche_id is not null").select("deal_key", "tranche_id").distinct()
    tried = names.select("deal_key", "tranche_id", "name", F.length("name").alias("rank")).unionByName(own.withColumns({"name": F.col("tranche_id").cast("string"), "rank": F.lit(1 << 30)}))
    hit = own.join(tried, ["deal_key", "tranche_id"]).join(facts.withColumnRenamed("tranche_name", "name"), ["deal_key", "name"])
    cols = [c for c in facts.columns if c not in ("deal_key", "tranche_name")]
    best = hit.groupBy("deal_key", "tranche_id").agg(F.min_by(F.struct("name", *cols), F.struct("rank", "name")).alias("f"))
    return best.select("deal_key", "tranche_id", "f.*")


def field_differences(pairs: DataFrame, key: list[str], fields: list[str], left: str = "e_", right: str = "d_", text: bool = True) -> DataFrame:
    """Long frame ``key, field, diff``: each pair of columns unpivoted and compared."""
    number = S.to_float if text else lambda c: c
    items = [F.struct(F.lit(f).alias("field"), amount_difference(number(F.col(left + f)), number(F.col(right + f)), rate=f.endswith("rate")).alias("diff")) for f in fields]
    return pairs.select(*key, F.inline(F.array(*items)))


def mismatches(diffs: DataFrame) -> DataFrame:
    return diffs.filter((F.col("diff") != "") & (F.col("diff") != "match"))


def id_conflicts(resolved: DataFrame) -> DataFrame:
    """Ids that more than one class of a deal resolves to."""
    g = resolved.filter("tranche_id is not null").groupBy("deal_key", "tranche_id").agg(F.sort_array(F.collect_list("class")).alias("classes"))
    return g.filter(F.size("classes") > 1)


def trusted_id(xml_id: Column, xml_status: Column, codes: Column) -> Column:
    """An exported id is trusted only if it was ok and there is no code to look up."""
    return F.when((xml_status == "ok") & (F.size(F.coalesce(codes, F.array().cast("array<string>"))) == 0), xml_id)


def facts_of(classes: DataFrame, names: DataFrame, facts: DataFrame) -> DataFrame:
    """M8: classes (``deal_key, class, tranche_id`` and the text fields of ``FACTS``) beside their stored facts.

    Adds ``db_<field>``, ``db_name``, ``diff_<field>`` and ``db_status``: ok,
    no_match, or no_data where the class row has no ``payment_date``.
    """
    found = fact_rows(classes, names, facts)
    have = [f for f in FACTS if f in found.columns]
    found = found.select("deal_key", "tranche_id", F.col("name").alias("db_name"), *[F.col(f).alias(f"db_{f}") for f in have])
    dated = F.trim(F.coalesce("payment_date", F.lit(""))) != ""
    d = classes.join(found, ["deal_key", "tranche_id"], "left")
    diffs = {f"diff_{f}": F.when(F.col("db_name").isNotNull(), amount_difference(S.to_float(F.col(f)), F.col(f"db_{f}").cast("double"), rate=f.endswith("rate"))).otherwise("") for f in have}
    return d.withColumns(diffs | {"db_status": F.when(F.col("db_name").isNotNull(), "ok").when(dated, "no_match").otherwise("no_data")})


def master_of(classes: DataFrame, master: DataFrame, balance: str = "orig_balance", order: str | None = None) -> DataFrame:
    """M8: classes with the original balance of their master row: ``db_original_balance, diff_original_balance, tm_status``."""
    d = master_rows(classes, master, order)
    stored = F.col(f"master.{balance}").cast("double")
    known = F.col("master").isNotNull()
    diff = F.when(known, amount_difference(S.to_float(F.col("original_balance")), stored, rate=False)).otherwise("")
    status = F.when(known, "ok").when(F.col("tranche_id").isNull(), "no_data").otherwise("no_match")
    return d.withColumns({"db_original_balance": stored, "diff_original_balance": diff, "tm_status": status}).drop("master", "master_id")


MAPPED = ["norm", "tranche_id", "tier", "status", "matched_code", "matched_name"]


def enrich(classes: DataFrame, codes: DataFrame, names: DataFrame, facts: DataFrame | None = None, master: DataFrame | None = None) -> DataFrame:
    """M9: class rows with the columns of :func:`resolve`, and beside stored facts and master rows if these are given.

    ``classes`` has one row per ``deal_key, class`` and the columns that
    ``resolve``, :func:`facts_of` and :func:`master_of` read; a column ``code``
    gets the code that matched. No row is lost or multiplied.
    """
    r = resolve(classes.select("deal_key", "class", "deal_name", "codes"), codes, names)
    d = classes.join(r.select("deal_key", "class", *MAPPED), ["deal_key", "class"], "left")
    return _stored(d, names, facts, master)


def _stored(d: DataFrame, names: DataFrame, facts: DataFrame | None, master: DataFrame | None) -> DataFrame:
    if "code" in d.columns:
        d = d.withColumn("code", F.coalesce("matched_code", "code"))
    if facts is not None:
        d = facts_of(d, names, facts)
    return d if master is None else master_of(d, master)


def process_export(classes: DataFrame, codes: DataFrame, names: DataFrame, facts: DataFrame | None = None, master: DataFrame | None = None) -> DataFrame:
    """Class rows of exported files, resolved anew unless their own id can be trusted.

    Beside the columns of :func:`enrich`, ``classes`` has ``xml_id``,
    ``xml_status`` and ``xml_tier``. An id that was ok stands where the class
    has no code; otherwise codes, then names decide. ``already`` says that the
    file's id stands, or that a code led to the same one.
    """
    asked = F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: ~F.upper(F.trim(c)).isin("", "N/A"))
    d = classes.withColumn("codes", asked).withColumn("__own", trusted_id(F.nullif(F.col("xml_id"), F.lit("")), F.col("xml_status"), F.col("codes")))
    # only rows whose id is not trusted are looked up
    r = resolve(d.filter("__own is null").select("deal_key", "class", "deal_name", "codes"), codes, names)
    d = d.join(r.select("deal_key", "class", *MAPPED), ["deal_key", "class"], "left")
    own = F.col("__own").isNotNull()
    same = (F.size("codes") > 0) & (F.col("xml_status") == "ok") & (F.col("tranche_id").cast("string") == F.col("xml_id")) & (F.col("tier") == "cusip")
    d = d.withColumn("already", own | F.coalesce(same, F.lit(False)))
    d = d.withColumns({"tier": F.when(own, F.coalesce(F.nullif(F.col("xml_tier"), F.lit("")), F.lit("xml"))).otherwise(F.col("tier")), "status": F.when(own, "ok").otherwise(F.coalesce("status", F.lit("unmapped"))), "tranche_id": F.when(own, F.col("__own")).otherwise(F.col("tranche_id").cast("string"))})
    return _stored(d.drop("__own"), names, facts, master)


def export_summary(deals: DataFrame, processed: DataFrame) -> DataFrame:
    """``deal_key, class_rows, mapped_ok, unmapped, ambiguous, already, status`` of every deal; missing where it has no class."""
    n = lambda test: F.count_if(test)
    s = F.col("status")
    g = processed.groupBy("deal_key").agg(F.count(F.lit(1)).alias("class_rows"), n(s == "ok").alias("mapped_ok"), n(~s.isin("ok", "ambiguous")).alias("unmapped"), n(s == "ambiguous").alias("ambiguous"), n(F.col("already")).alias("already"))
    d = deals.select("deal_key").distinct().join(g, "deal_key", "left").na.fill(0, ["class_rows", "mapped_ok", "unmapped", "ambiguous", "already"])
    return d.withColumn("status", F.when(F.col("class_rows") == 0, "missing").when(F.col("mapped_ok") < F.col("class_rows"), "partial").otherwise("ok"))
