"""Raw rows to prepared records, their profile and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text, vocab

KEY_COLUMNS = ("name_latin", "addr_latin", "name_core", "name_skeleton", "name_aka", "legal_suffix")


def prepare(raw: DataFrame, native: dict[str, str] | None = None) -> DataFrame:
    """raw (entity_id, business_name, business_address, country) with every derived column; no cell is null.

    Stages are separate selects, so that an Arrow kernel's result is computed
    once and used many times.
    """
    base = raw.select(
        F.trim(text.some(F.col("entity_id"))).alias("entity_id"), text.some(F.col("country")).alias("country_raw"), text.normalise_country(F.col("country")).alias("country_norm"),
        text.some(F.col("business_name")).alias("name_raw"), text.some(F.col("business_address")).alias("addr_raw"),
    )
    base = base.withColumns({"name_has_embedded_phone": text.has_phone(F.col("name_raw")), "addr_has_embedded_phone": text.has_phone(F.col("addr_raw"))})
    base = base.withColumn("__name", text.strip_name_url(text.strip_phone(F.col("name_raw"))))
    name, alias = text.split_alias(F.col("__name"))
    base = base.withColumns({"__name": name, "__alias": alias, "__addr": text.strip_phone(F.col("addr_raw"))})
    base = base.withColumns({"__cf": text.pre_normalise(F.col("__name")), "addr_norm": text.normalise_address(F.col("__addr")), "__alias": text.normalise_name(F.col("__alias"))})
    norm = text.finish_normalise(F.regexp_replace("__cf", vocab.MESSRS, ""))
    base = base.withColumn("name_norm", norm).withColumn("name_norm", F.when(text.is_junk(F.col("name_norm")), "").otherwise(F.col("name_norm")))
    base = base.withColumn("__root", F.when(F.col("name_norm") != "", text.domain_root(F.col("__cf"))).otherwise("")).withColumn("is_domain_name", F.col("__root") != "")
    base = base.withColumns({"name_latin": text.latin_name(F.col("name_norm"), native), "__alias": text.latin_name(F.col("__alias"), native), "addr_latin": text.canonical_address(text.romanise(F.col("addr_norm")))})
    core, suffix = text.legal_suffix(F.col("name_latin"), F.col("country_norm"))
    alias_core, _ = text.legal_suffix(F.col("__alias"), F.col("country_norm"))
    root = text.romanise(F.col("__root"))
    core = F.when(F.col("is_domain_name"), root).otherwise(F.coalesce(F.nullif(core, F.lit("")), F.col("name_latin")))
    base = base.withColumns({"name_core": core, "legal_suffix": F.when(F.col("is_domain_name"), "").otherwise(suffix), "name_aka": alias_core})
    base = base.withColumns({
        "name_skeleton": text.skeleton(F.col("name_core")), "name_script": text.name_script(F.col("name_norm")), "addr_script": text.name_script(F.col("addr_norm")),
        "name_is_mixed_script": text.is_mixed_script(F.col("name_norm")), "name_was_romanized": ~F.col("name_norm").rlike(text.ASCII), "addr_was_romanized": ~F.col("addr_norm").rlike(text.ASCII),
        "postal_code": text.postal_code(F.col("addr_latin"), F.col("country_norm")), "has_landmark": text.has_landmark(F.col("addr_latin")),
        "name_missing": F.col("name_norm") == "", "addr_missing": F.col("addr_norm") == "", "name_n_tokens": text.n_tokens(F.col("name_latin")).cast("short"), "addr_n_tokens": text.n_tokens(F.col("addr_latin")).cast("short"),
    })
    base = base.withColumns({"street_number": text.street_number(F.col("addr_latin"), F.col("postal_code")), "addr_is_multi_location": F.col("addr_n_tokens") >= vocab.MULTI_LOCATION_TOKENS})
    return base.drop("__name", "__alias", "__addr", "__cf", "__root")


def resolver_keys(records: DataFrame, name: str = "name_latin", addr: str = "addr_latin") -> DataFrame:
    """id, name and address keys and the building of prepared records."""
    parsed = text.with_address(records, F.col(addr), F.col("country_norm"), F.col("postal_code"), "__k").withColumn("__n", text.parse_name(F.col(name)))
    out = parsed.select(F.col("entity_id").alias("id"), "__n", "__k", F.col("country_norm").alias("country"), text.building(F.col("country_norm"), F.col("__k")).alias("building"))
    return out.select("id", "__n.*", "__k.*", "country", "building")


def histograms(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, value, n: how often each value occurs; counts, so that shards merge by adding."""
    entry = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return records.select(entry.alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))


def profile(records: DataFrame, by: str) -> DataFrame:
    """Counts of each flag for each value of ``by``; sums, so that shards merge by adding."""
    flags = [c for c, t in records.dtypes if t == "boolean"]
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in flags), F.count_if(F.col("postal_code") != "").alias("n_postal"), F.sum("name_n_tokens").alias("sum_name_tokens"), F.sum("addr_n_tokens").alias("sum_addr_tokens"))


def assert_latin(records: DataFrame) -> DataFrame:
    """The records, failing the job at the first key column with a character outside ASCII."""
    bad: Column = F.lit(False)
    for c in KEY_COLUMNS:
        bad = bad | ~F.col(c).rlike(text.ASCII)
    # In the projection, not a filter: a filter would be pushed below the keys and compute them all again.
    checked = F.when(bad, F.raise_error(F.concat(F.lit("key outside ASCII in record "), "entity_id"))).otherwise(F.col("entity_id"))
    return records.withColumn("entity_id", checked)


def checks(records: DataFrame, raw: DataFrame, prefix: str) -> DataFrame:
    """check, passed, detail as rows: row count, unique ids, prefix, no nulls, keys in ASCII."""
    nulls = sum((F.col(c).isNull().cast("int") for c in records.columns[1:]), F.col(records.columns[0]).isNull().cast("int"))
    ascii_ = F.lit(True)
    for c in KEY_COLUMNS:
        ascii_ = ascii_ & F.col(c).rlike(text.ASCII)
    one = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_if(~F.col("entity_id").startswith(prefix)).alias("bad_prefix"), F.sum(nulls).alias("nulls"), F.count_if(~ascii_).alias("not_ascii")).join(F.broadcast(raw.agg(F.count(F.lit(1)).alias("raw"))))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail"))
    rows = F.array(row("rows kept", F.col("n") == F.col("raw"), F.col("n")), row("ids unique", F.col("n") == F.col("ids"), F.col("n") - F.col("ids")), row("id prefix", F.col("bad_prefix") == 0, F.col("bad_prefix")), row("no nulls", F.coalesce("nulls", F.lit(0)) == 0, F.coalesce("nulls", F.lit(0))), row("latin keys", F.col("not_ascii") == 0, F.col("not_ascii")))
    return one.select(F.explode(rows).alias("r")).select("r.*")
