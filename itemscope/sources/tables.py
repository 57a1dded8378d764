"""Input tables as CSV or Parquet, and the sink of result tables."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from itemscope.operators.responses import wide_to_long
from itemscope.schema import ITEM_PARAMS, SUBJECT_ABILITY
from itemscope.session import local_table

# File names tried for each core table, in this order.
CORE_FILES = {
    "response_matrix": ["response_matrix.csv", "response_matrix(3).csv"],
    "case_metadata": ["case_metadata.csv", "case_metadata(3).csv"],
    "item_params": ["irt_1pl_item_parameters.csv", "irt_1pl_item_parameters(3).csv"],
    "subject_ability": ["irt_1pl_subject_ability.csv", "irt_1pl_subject_ability(3).csv"],
    "missing_summary": ["missing_response_summary.csv"],
}
_OPTIONAL = {"missing_summary"}


def _exists(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def first_existing(spark, folder, names, required=True):
    """The first of `names` that exists under `folder`; None if it is optional and absent."""
    paths = [f"{folder.rstrip('/')}/{n}" for n in names]
    for path in paths:
        if _exists(spark, path):
            return path
    if required:
        raise FileNotFoundError("none of these files exists: " + ", ".join(paths))
    return None


def read_csv(spark, path, schema=None, multi_line=True):
    """CSV with a header; every column is text without a schema.

    Columns of the schema are taken by name, those of the file that it does not list stay text.
    Quoted cells may span lines; turn `multi_line` off for large files without such cells, so
    that one file can be read by many tasks.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    if schema is None:
        return raw
    typed = {f.name: f.dataType for f in schema}
    return raw.select(*[F.col(f"`{c}`").try_cast(typed[c]).alias(c) if c in typed
                        else F.col(f"`{c}`") for c in raw.columns])


#: A comma and the cell after it. Quoted cells hold commas and doubled quotes.
_CELL = r',[ \t]*"(?:[^"]++|"")*+"[ \t]*(?=,|$)|,[^,]*'
# Cells, in small letters, that stand for no answer.
_NO_ANSWER = ["", "nan", "na", "n/a", "#n/a", "<na>", "null", "none"]


def _cells(line):
    """The cells of a CSV line, without the quotes around them."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(0))

    def plain(cell):
        cell = F.btrim(F.substring(cell, 2, 1 << 30), F.lit(" \t\r"))
        inside = F.regexp_extract(cell, '(?s)^"(.*)"$', 1)
        return F.when(cell.rlike('(?s)^".*"$'), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(cell)
    return F.transform(found, plain)


def _matrix_names(spark, path):
    """(names, at, n): item ids by position, the position of the subject, and the number of cells."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"no header in {path}")
    line = local_table(spark, [(header["value"].lstrip("\ufeff"),)], {"value": pa.string()})
    names = line.select(F.posexplode(_cells(F.col("value"))).alias("pos", "item_id"))
    found = names.agg(F.max(F.when(F.col("item_id") == "model", F.col("pos"))), F.count("pos")).first()
    return names, found[0] or 0, found[1]


def read_response_matrix(spark, path):
    """Wide subject x item CSV to rows (subject, item_id, y), without a frame of many columns.

    Lines are split into cells by the grammar of CSV (quoted cells may hold commas and quotes, not
    line ends), and cells meet their item name by position. The first line of a file is its header,
    no other. The subject is the column `model`, or the first one where no column has that name. A
    cell is 0, 1 or one of the words for a missing answer, which gives no row; other cells, and
    lines longer than the header, are errors.
    """
    names, at, n = _matrix_names(spark, path)
    # whole lines as single cells: the reader takes off the headers and reads a file by many tasks
    lines = spark.read.schema("value string").csv(path, header=True, sep="\u0001", quote="")
    cells = _cells(F.col("value"))
    body = lines.filter(F.trim("value") != "").select(cells.alias("cells")).select(F.when(
        F.size("cells") <= n, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit(
            "a line has more cells than the header: "), F.col("cells")[at])).cast("array<string>")).alias("cells"))
    long = body.select(F.col("cells")[at].alias("subject"), F.posexplode("cells").alias("pos", "cell")).filter(
        (F.col("pos") != at) & ~F.lower("cell").isin(_NO_ANSWER))
    number = F.col("cell").try_cast("double")
    refused = F.raise_error(F.concat(F.lit("the answer of "), F.col("subject"), F.lit(" to "), F.col("item_id"),
                                     F.lit(" is neither 0 nor 1: "), F.col("cell")))
    y = F.when(number == 0, 0).when(number == 1, 1).otherwise(refused.cast("int"))
    return long.join(names, "pos").select("subject", "item_id", y.alias("y"))


def response_matrix_items(spark, path):
    """Item ids of a wide response matrix, answered or not."""
    names, at, _ = _matrix_names(spark, path)
    return names.filter(F.col("pos") != at).select("item_id")


def read_factors(spark, paths):
    """Subject factors of several fits as one table; a fit has NULL in the factors beyond its own."""
    def one(path):
        raw = read_csv(spark, path, multi_line=False)
        kinds = {"model": "string", "k_factors": "int", "correct": "long", "observed_total": "long",
                 "missing_total": "long"}    # all others are numbers
        return raw.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "double")).alias(c) for c in raw.columns])
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))
    factors = sorted((c for c in every.columns if c.startswith("factor_")), key=lambda c: int(c[7:]))
    first = [c for c in ("k_factors", "model", "bias") if c in every.columns]
    return every.select(*first, *factors, *[c for c in every.columns if c not in (*first, *factors)])


def _core_table(spark, path, schema=None):
    if not path.endswith(".parquet"):
        return read_csv(spark, path, schema)
    raw, kinds = spark.read.parquet(path), {f.name: f.dataType for f in schema or ()}
    return raw.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`")
                        for c in raw.columns])


def _core_matrix(spark, path):
    """(responses, items) of the wide response matrix, in CSV or Parquet."""
    if not path.endswith(".parquet"):
        return read_response_matrix(spark, path), response_matrix_items(spark, path)
    wide = spark.read.parquet(path)
    subject = "model" if "model" in wide.columns else wide.columns[0]
    items = local_table(spark, [(c,) for c in wide.columns if c != subject], {"item_id": pa.string()})
    return wide_to_long(wide), items


def load_core_tables(spark, folder):
    """The response rows, metadata, item and subject parameters, and the optional missing log.

    A table without a CSV file is read from Parquet of the same name. `paths` names the file behind
    every table.
    """
    found = {t: first_existing(spark, folder, [*names, *[n.replace(".csv", ".parquet") for n in names]],
                               t not in _OPTIONAL) for t, names in CORE_FILES.items()}
    missing = found["missing_summary"]
    responses, matrix_items = _core_matrix(spark, found["response_matrix"])
    return {
        "responses": responses,
        "matrix_items": matrix_items,
        "case_metadata": _core_table(spark, found["case_metadata"]),
        "item_params": _core_table(spark, found["item_params"], ITEM_PARAMS),
        "subject_ability": _core_table(spark, found["subject_ability"], SUBJECT_ABILITY),
        "missing_summary": _core_table(spark, missing) if missing
        else spark.createDataFrame([], "model string"),
        "paths": spark.createDataFrame([(t, p or "") for t, p in found.items()],
                                       "table string, path string"),
    }


def save_tables(tables, folder, fmt="csv"):
    """Write every DataFrame of the dict under its name; other values are skipped."""
    for name, df in tables.items():
        if hasattr(df, "write"):
            writer = df.write.mode("overwrite")
            if fmt == "csv":
                writer = writer.option("header", True).option("escape", '"')
            writer.format(fmt).save(f"{folder.rstrip('/')}/{name}")
