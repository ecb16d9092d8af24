"""Record files: strict, lenient and counting readers, the docstore in its three forms, and checked writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as S

METADATA = S.MapType(S.StringType(), S.StringType())
DOCUMENT = S.StructType([S.StructField("id", S.StringType()), S.StructField("text", S.StringType()), S.StructField("metadata", METADATA)])


def read_strict(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT) -> DataFrame:
    """As ``read_strict``, but malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_counting(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT) -> DataFrame:
    """All lines; ``_corrupt_record`` holds a malformed one, so valid and invalid lines can be counted."""
    return spark.read.schema(S.StructType([*schema.fields, S.StructField("_corrupt_record", S.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, metadata`` of all records; missing metadata is empty, records with a blank text are left out, and a record
    without an id or a text fails the read where it is met."""
    lacking = F.col("id").isNull() | F.col("text").isNull()
    rows = read_strict(spark, path).withColumn("id", F.when(lacking, F.raise_error(F.lit("a record lacks its id or text"))).otherwise(F.col("id"))).where("trim(text) <> ''")
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast(METADATA)))


def read_docstore(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a docstore: one object a line, or one ``{"documents": [...]}`` object; told apart by content."""
    whole = S.StructType([S.StructField("documents", S.ArrayType(DOCUMENT)), *DOCUMENT.fields])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").json(path)
    listed = rows.where("documents is not null").select(F.explode("documents").alias("d")).select("d.*")
    single = rows.where("documents is null and id is not null").select("id", "text", "metadata")
    if rows.where("documents is not null or id is not null").limit(1).count() == 0:
        many = spark.read.schema(whole).option("multiLine", "true").json(path)
        return many.where("documents is not null").select(F.explode("documents").alias("d")).select("d.*")
    return listed.unionByName(single)


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """``source_id, page_number, text`` of ``root/<source>/pages.jsonl``: the last row of a page counts, pages under 1 are left out.

    The place of a row in its file is the begin of its block and its place in the task that reads the block.
    """
    schema = S.StructType([S.StructField("page_number", S.IntegerType()), S.StructField("text", S.StringType())])
    rows = spark.read.schema(schema).json(f"{root}/*/pages.jsonl").withColumn("source_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/pages\.jsonl$", 1))
    rows = rows.select("source_id", "page_number", "text", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return rows.where("page_number > 0").groupBy("source_id", "page_number").agg(F.max_by("text", "at").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; the committed files appear all at once."""
    df.write.mode("overwrite").json(path)


def append_index(vectors: DataFrame, path: str) -> None:
    """Append ``doc_id, embedding`` at length 1 to an index table; all vectors must have one length, that of the index."""
    from folioflow.functions.vectors import normalized

    spark = vectors.sparkSession
    sizes = [r.n for r in vectors.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        sizes += [r.n for r in spark.read.parquet(path).select(F.size("embedding").alias("n")).limit(1).collect()]
    if len(set(sizes)) != 1 or sizes[0] < 1:
        raise ValueError(f"vectors of one length are needed, not {sorted(set(sizes))}")
    vectors.select("doc_id", normalized(F.col("embedding")).cast("array<float>").alias("embedding")).write.mode("append").parquet(path)


def left_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key ``done`` lacks: where a run that was cut off goes on."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
