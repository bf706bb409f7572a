"""Payload parsers: landed text of API responses -> observations, as DataFrame functions; a pluggable source; corpus I/O."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from loam.functions import text as T

#: Daily values at or below this are missing.
MISSING = -990.0
RAW_CHARS, ABSTRACT_CHARS = 4096, 1000


def daily_points(payloads: DataFrame, body: str = "body", most_dates: int = 31) -> DataFrame:
    """{"properties":{"parameter":{P:{yyyymmdd:v}}}}: a row for each of the first dates of the first parameter, with the
    values of all parameters at that date; a payload without any gives one row with its first characters.  (id, date, values, raw)"""
    m = F.from_json(F.col(body), "properties struct<parameter:map<string,map<string,double>>>")["properties"]["parameter"]
    p = payloads.select("id", F.col(body).alias("__b"), m.alias("m"))
    dates = F.slice(F.map_keys(F.get(F.map_values("m"), F.lit(0))), 1, most_dates)
    at = lambda d: F.map_filter(F.transform_values("m", lambda _, v: F.try_element_at(v, d)), lambda _, v: v.isNotNull() & (v > MISSING))
    rows = p.select("id", "__b", "m", F.explode_outer(dates).alias("date")).withColumn("values", F.when(F.col("date").isNotNull(), at(F.col("date"))))
    none = F.coalesce(F.size("values"), F.lit(0)) <= 0
    return rows.where(~none | F.col("date").isNull()).select("id", "date", F.when(~none, F.col("values")).alias("values"), F.when(none, F.substring("__b", 1, RAW_CHARS)).alias("raw"))


def indicators(payloads: DataFrame, body: str = "body", most: int = 10) -> DataFrame:
    """{"value":[{IndicatorCode, SpatialDim, TimeDim, NumericValue}]}: the first rows of each payload."""
    v = F.from_json(F.col(body), "value array<struct<IndicatorCode:string,SpatialDim:string,TimeDim:bigint,NumericValue:double>>")["value"]
    return payloads.select("id", F.posexplode(F.slice(v, 1, most)).alias("pos", "v")).select("id", "pos", F.col("v.IndicatorCode").alias("indicator"), F.col("v.SpatialDim").alias("place"), F.col("v.TimeDim").alias("year"), F.col("v.NumericValue").alias("value"))


def paged(payloads: DataFrame, body: str = "body", most: int = 10) -> DataFrame:
    """[{page}, [{indicator, country, date, value}]]: the first rows of the second element."""
    v = F.from_json(F.get_json_object(F.col(body), "$[1]"), "array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,date:string,value:double>>")
    return payloads.select("id", F.posexplode(F.slice(v, 1, most)).alias("pos", "v")).select("id", "pos", F.col("v.country.value").alias("country"), F.col("v.date").alias("year"), F.col("v.value").alias("value"), F.col("v.indicator.value").alias("indicator"))


def atom_entries(payloads: DataFrame, body: str = "body") -> DataFrame:
    """<entry> elements: title and summary with single spaces, id as url; entries without a title are left out."""
    e = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    r = payloads.select("id", F.posexplode(e).alias("pos", "x"))
    clean = lambda tag: F.coalesce(T.collapse(T.xml_tag(F.col("x"), tag)), F.lit(""))
    return r.select("id", "pos", clean("title").alias("title"), F.substring(clean("summary"), 1, ABSTRACT_CHARS).alias("summary"), F.trim(T.xml_tag(F.col("x"), "id")).alias("url")).where("title <> ''")


def or_fallback(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """rows, or the fallback's where there are none: decided in one plan, by an outer count of at most one row."""
    some = rows.limit(1).agg(F.count("*").alias("__n"))
    return rows.unionByName(fallback.join(F.broadcast(some)).where("__n = 0").drop("__n"))


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port (80 and 443 where none is given) and path; null for other schemes."""
    scheme = F.regexp_extract(url, r"^(https?)://", 1)
    ok = scheme != ""
    rest = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    port = F.regexp_extract(rest, r":(\d+)$", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1)
    return {
        "scheme": F.when(ok, scheme),
        "host": F.when(ok, F.regexp_replace(rest, r":\d+$", "")),
        "port": F.when(ok, F.when(port != "", port.cast("int")).when(scheme == "https", 443).otherwise(80)),
        "path": F.when(ok, F.when(path == "", "/").when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))),
    }


# ---------------------------------------------------------------- hypotheses


# Causal phrases and their confidence.
PHRASES = [("causes", 0.75), ("leads to", 0.65), ("results in", 0.60), ("influences", 0.55), ("correlates with", 0.45)]


def numeric_pairs(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Every unordered pair of a row's numeric fields, in field order: (keys, cause, effect, confidence)."""
    f = [F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v")) for n in names]
    both = F.array(*[F.struct(a.alias("a"), b.alias("b")) for i, a in enumerate(f) for b in f[i + 1 :]])
    r = rows.select(*keys, F.explode(both).alias("p")).where("p.a.v is not null and p.b.v is not null")
    size = lambda x: F.least(F.abs(F.col(x)), F.lit(100.0))
    c = F.least(F.greatest(0.45 + F.sqrt(size("p.a.v") * size("p.b.v")) / 100, F.lit(0.1)), F.lit(0.9))
    return r.select(*keys, F.col("p.a.k").alias("cause"), F.col("p.b.k").alias("effect"), c.alias("confidence"))


def json_numeric_pairs(rows: DataFrame, key: str, body: str) -> DataFrame:
    """The same for the numeric top-level fields of JSON texts, in order of their names."""
    m = F.array_sort(F.filter(F.transform(F.map_entries(F.from_json(F.col(body), "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].try_cast("double").alias("v"))), lambda e: e["v"].isNotNull()))
    r = rows.select(key, F.explode(m).alias("a"), m.alias("m")).select(key, "a", F.explode("m").alias("b")).where("a.k < b.k")
    size = lambda x: F.least(F.abs(F.col(x)), F.lit(100.0))
    c = F.least(F.greatest(0.45 + F.sqrt(size("a.v") * size("b.v")) / 100, F.lit(0.1)), F.lit(0.9))
    return r.select(key, F.col("a.k").alias("cause"), F.col("b.k").alias("effect"), c.alias("confidence"))


def phrase_hypotheses(rows: DataFrame, key: str, text: str, phrases: list[tuple[str, float]] = PHRASES) -> DataFrame:
    """For each phrase its first place in the lower-cased text: the word before and the word after, without what is not a
    letter at their ends; (key, phrase, cause, effect, confidence).  Words of one byte or none don't count."""
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("confidence")) for p, c in phrases])
    r = rows.select(key, F.lower(F.col(text)).alias("t"), F.explode(table).alias("p"))
    at = F.instr(F.col("t"), F.col("p.phrase"))
    first = lambda c: F.regexp_extract(c, rf"^{T.SPACE[:-1]}*([^{T.SPACE[1:-2]}]+)", 1)
    before = F.reverse(first(F.reverse(F.substring("t", F.lit(1), at - 1))))  # only these words are looked for, not all
    after = first(F.substring("t", at + F.length("p.phrase"), F.length("t")))
    or_ = lambda c, x: F.coalesce(F.nullif(c, F.lit("")), F.lit(x))
    bare = lambda c: F.regexp_replace(c, r"^\P{L}+|\P{L}+$", "")
    r = r.where(at > 0).select(key, F.col("p.phrase").alias("phrase"), or_(before, "X").alias("c"), or_(after, "Y").alias("e"), F.col("p.confidence").alias("confidence"))
    return r.where((F.octet_length("c") > 1) & (F.octet_length("e") > 1)).select(key, "phrase", bare(F.col("c")).alias("cause"), bare(F.col("e")).alias("effect"), "confidence")


# ---------------------------------------------------------------- corpus files


CORPUS = "version int, total_rejected bigint, positive_feedback bigint, negative_feedback bigint, clock bigint, entries array<struct<id:bigint,source:string,title:string,confidence:double,pheromone:double,quality:double,tier:int,samples:int,ingested_at:bigint>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus snapshot: missing fields by their defaults, tiers within 0..2."""
    e = spark.read.schema(CORPUS).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return e.select(or_("id", 0), or_("source", "unknown"), or_("title", ""), or_("confidence", 0.5), or_("pheromone", 0.5), or_("quality", 0.5), F.least(F.greatest(F.coalesce("tier", F.lit(0)), F.lit(0)), F.lit(2)).alias("tier"), or_("samples", 0), or_("ingested_at", 0))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One JSON object per row, numbers of four decimals: splittable, and read in parallel again."""
    four = lambda c: F.round(c, 4).alias(c)
    corpus.select("id", "source", "title", four("confidence"), four("pheromone"), four("quality"), "tier", "samples", "ingested_at").write.mode("overwrite").json(path)


def export_tables(path: str, **tables: DataFrame) -> None:
    """The store, a Parquet folder per table: everything, deposits and agents too."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def import_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


# ---------------------------------------------------------------- pluggable source


class ObservationSource(DataSource):
    """format("observations"): rows of a JSON-lines or text folder, a partition for each file; subclass to fetch elsewhere."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return "source string, content string, url string, seq bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.label = options["path"], options.get("source", "unknown")

    def partitions(self):
        from pyarrow import fs
        from pyspark.sql.datasource import InputPartition

        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return [InputPartition(f.path) for f in found if f.is_file]

    def read(self, partition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as f:
            for i, line in enumerate(f.read().decode().splitlines()):
                yield (self.label, line, partition.value, i)
