"""AS relationship and organization text, newest-file discovery, and the explorer's JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSETS = {
    "overview": "meta map<string,string>, groups array<struct<id:string,label:string,seedAsn:bigint,asnCount:bigint,country:string>>, links array<struct<source:string,target:string,count:bigint,peerCount:bigint,providerCustomerCount:bigint>>",
    "root": "groups array<struct<id:string,label:string,count:bigint,seedAsn:bigint,color:string>>, links array<struct<source:string,target:string,count:bigint>>",
    "group": "id string, label string, count bigint, partition string, children array<struct<id:string,label:string,count:bigint,seedAsn:bigint,x:double,y:double>>, links array<struct<source:string,target:string,count:bigint>>",
    "tile": "id string, parent string, label string, count bigint, seedAsn bigint, partition string, connectedComponents bigint, externalLinkCount bigint, nodes array<struct<asn:bigint,name:string,degree:bigint,group:string,x:double,y:double>>, links array<struct<source:bigint,target:bigint,relationship:string>>",
    "index": "doc map<string,array<string>>",
    "adjacency": "doc map<string,struct<neighbors:array<array<string>>>>",
    "names": "doc map<string,struct<name:string,organization:string,country:string>>",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line in file order. A compressed file is one split, so row ids follow its lines."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines


def edges(lines: DataFrame) -> DataFrame:
    """a, b, rel, line_no of the rows "a|b|rel"; comments and blanks are skipped. Rows of another shape are an error."""
    rows = lines.where(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).select("line_no", F.split("line", r"\|").alias("f"))
    rel = F.get("f", F.lit(2)).try_cast("int")
    good = rel.isin(0, -1)
    checked = F.when(good, rel).otherwise(F.raise_error(F.concat(F.lit("unknown relationship in line "), F.col("line_no"))).cast("int"))
    return rows.select(F.get("f", F.lit(0)).cast("bigint").alias("a"), F.get("f", F.lit(1)).cast("bigint").alias("b"), checked.alias("rel"), "line_no")


def clique(lines: DataFrame) -> DataFrame:
    """asn of "# input clique:" comments."""
    text = F.regexp_extract("line", r"^# input clique:\s*(.*)$", 1)
    return lines.where(F.startswith("line", F.lit("# input clique:"))).select(F.explode(F.split(F.trim(text), r"\s+")).alias("t")).where("t <> ''").select(F.col("t").cast("bigint").alias("asn")).distinct()


def observation_dates(lines: DataFrame) -> DataFrame:
    """date texts of "# source:topology|BGP|date" comments."""
    return lines.where(F.startswith("line", F.lit("# source:topology|BGP|"))).select(F.get(F.split("line", r"\|"), F.lit(2)).alias("date")).distinct()


def organizations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(org_id, name, country) and (asn, name, org_id). Which section a row is in comes from the last format comment."""
    mode = F.when(F.startswith("line", F.lit("# format:org_id")), "org").when(F.startswith("line", F.lit("# format:aut")), "as")
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("mode", F.last(mode, ignorenulls=True).over(so_far)).where(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).withColumn("f", F.split("line", r"\|"))
    field = lambda i: F.get("f", F.lit(i))
    orgs = rows.where("mode = 'org'").select(field(0).alias("org_id"), field(2).alias("name"), field(3).alias("country"))
    info = rows.where("mode = 'as'").select(field(0).cast("bigint").alias("asn"), field(2).alias("name"), field(3).alias("org_id"))
    return orgs, info


def newest(names: DataFrame, column: str, pattern: str, today: Column) -> DataFrame:
    """name: the greatest file name of an index listing that matches pattern (group 1: YYYYMMDD) and is not after today."""
    found = names.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("name")).distinct()
    day = F.regexp_extract("name", pattern, 1)
    return found.where(day <= F.date_format(today, "yyyyMMdd")).agg(F.max("name").alias("name"))


def read_asset(spark: SparkSession, kind: str, path: str, lines: bool = False) -> DataFrame:
    """The explorer's JSON documents of one kind: overview, root, group, tile; index, adjacency and names as key rows. With
    `lines`, each line is a document of its own, as write_topology writes those three; else each file is one."""
    if kind in ("index", "adjacency", "names"):
        shape = ASSETS[kind].split(" ", 1)[1]
        docs = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", shape)).alias("key", "v"))
        asn = F.col("key").cast("bigint").alias("asn")
        if kind == "index":
            item = lambda i: F.get("v", F.lit(i))
            return docs.select(asn, item(0).alias("grp"), item(1).alias("tile"), item(2).alias("name"), item(3).cast("bigint").alias("degree"))
        if kind == "adjacency":
            return docs.select(asn, F.explode("v.neighbors").alias("n")).select("asn", F.get("n", F.lit(0)).cast("bigint").alias("nbr"), F.get("n", F.lit(1)).alias("role"))
        return docs.select(asn, "v.*")
    return spark.read.schema(ASSETS[kind]).json(path, multiLine=True)
