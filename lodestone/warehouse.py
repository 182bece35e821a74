"""Tables of a deployment under one folder: facts by release, staged rows and ledgers in versions, switched by their success mark.

Facts are appended by release and replaced a release at a time. What changes row by row (ledgers, staged rows) is written
whole as a new version beside the old one; a version counts once Spark has marked it as written, so a reader never sees half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import calls, release
from lodestone.sources import sinks

_SOURCE = "source_doc_id string, source_locator string"
#: Columns of the tables, release_id apart.
FACTS = {
    "document": "doc_id string, kind string, title string, url string, division string, sha256 string, page_count int",
    "product_family": f"family_id string, division string, category string, name string, summary string, applications array<string>, standards array<string>, {_SOURCE}",
    "product": f"product_id string, family_id string, model_name string, variant string, description string, attributes string, {_SOURCE}",
    "capability_row": (
        "cap_id string, family_id string, comp_type string, lubricated boolean, cooling string, capacity_min double, capacity_max double, capacity_unit string, "
        f"discharge_p_min double, discharge_p_max double, pressure_unit string, driver array<string>, standards array<string>, {_SOURCE}"
    ),
    "capability_gas": "cap_id string, gas string",
    "company_fact": f"fact_id string, kind string, value string, detail string, {_SOURCE}",
    "office": f"office_id string, name string, city string, region string, address string, phone string, email string, serves_divisions array<string>, {_SOURCE}",
    "region_state": "state string, region string, office_id string",
    "chunks": "doc string, chunk_id string, locator string, heading_path array<string>, content string, token_count int, family_ids array<string>, division string",
}
RELEASE = "release_id string, built_at timestamp, is_active boolean, candidate string, documents array<string>"
CANDIDATE = "id string, client string, created_at timestamp, status string"
FAMILIES = "family_id string, division string, category string, name string, summary string, source string"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        jpath, fs = self._path(f"{self.root}/{name}")
        return fs.exists(jpath)

    def version(self, name: str) -> int:
        """The latest version that was written to its end; 0 if there is none."""
        if not self.has(name):
            return 0
        jpath, fs = self._path(f"{self.root}/{name}")
        found = [0]
        for s in fs.listStatus(jpath):
            folder = s.getPath()
            if folder.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                found.append(int(folder.getName()))
        return max(found)

    def _as(self, df: DataFrame, schema: str) -> DataFrame:
        """Columns of the schema, in its types; those that aren't there are null."""
        fields = self.spark.createDataFrame([], schema).schema
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A versioned table as it stands; empty under ``schema`` before its first version."""
        n = self.version(name)
        if not n:
            if schema is None:
                raise ValueError(f"nothing stored as {name}")
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(f"{self.root}/{name}/{n:06d}")
        return df if schema is None else self._as(df, schema)

    def write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}/{self.version(name) + 1:06d}", mode="overwrite")

    def facts(self, table: str, release_id: str | None = None) -> DataFrame:
        """A facts table with release_id, of one release if one is named."""
        schema = f"{FACTS[table]}, release_id string"
        if not self.has(f"facts/{table}"):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/facts/{table}")
        return df if release_id is None else df.where(F.col("release_id") == release_id)

    def publish(self, table: str, rows: DataFrame) -> None:
        """Rows of whole releases in place of what these releases had."""
        sinks.replace_release(self._as(rows, f"{FACTS[table]}, release_id string"), f"{self.root}/facts/{table}")

    def releases(self) -> DataFrame:
        return self.read("release", RELEASE)

    def active_id(self) -> str:
        return release.active_release(self.releases()).first().release_id

    def staged(self, candidate: str) -> dict[str, DataFrame]:
        """A candidate's staged tables that there are."""
        return {t: self.read(f"staging/{candidate}/{t}") for t in FACTS if self.has(f"staging/{candidate}/{t}")}

    def tools(self, release_id: str | None = None, aliases: dict[str, str] | None = None) -> calls.Store:
        """What the tools read, of the active release if none is named."""
        name = release_id or self.active_id()
        of = lambda t: self.facts(t, name).drop("release_id")
        chunks = of("chunks").withColumnRenamed("doc", "doc_id")
        slug = "".join(c if c.isalnum() else "_" for c in name.lower()).strip("_")
        if self.has(f"vectors/chunk_embedding_{slug}"):
            chunks = chunks.join(self.spark.read.parquet(f"{self.root}/vectors/chunk_embedding_{slug}"), "chunk_id", "left")
        else:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        tables = (of(t) for t in ("capability_row", "product_family", "capability_gas", "product", "company_fact", "office", "region_state"))
        return calls.Store(*tables, chunks, of("document").select("doc_id", "title", "url"), aliases or {})
