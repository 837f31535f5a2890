"""Fixed-width quote files: scan, typing, raw audit and the inverse used by tests and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadwake.operators.checks import require

LINE_WIDTH = 245
# Fixed values: (name, start, end) of the 26 fields, half-open, counted from 0.
LAYOUT = (
    ("TIPREG", 0, 2), ("DATA", 2, 10), ("CODBDI", 10, 12), ("CODNEG", 12, 24), ("TPMERC", 24, 27), ("NOMRES", 27, 39),
    ("ESPECI", 39, 49), ("PRAZOT", 49, 52), ("MODREF", 52, 56), ("PREABE", 56, 69), ("PREMAX", 69, 82), ("PREMIN", 82, 95),
    ("PREMED", 95, 108), ("PREULT", 108, 121), ("PREOFC", 121, 134), ("PREOFV", 134, 147), ("TOTNEG", 147, 152),
    ("QUATOT", 152, 170), ("VOLTOT", 170, 188), ("PREEXE", 188, 201), ("INDOPC", 201, 202), ("DATVEN", 202, 210),
    ("FATCOT", 210, 217), ("PTOEXE", 217, 230), ("CODISI", 230, 242), ("DISMES", 242, 245))
MONEY = ("PREABE", "PREMAX", "PREMIN", "PREMED", "PREULT", "PREOFC", "PREOFV", "VOLTOT", "PREEXE")
INTEGERS = ("TOTNEG", "QUATOT")
TRAILER_COUNT = (31, 42)
DOMAIN = {"DATA": "date", "CODNEG": "instrument", "NOMRES": "name", "ESPECI": "spec", "CODBDI": "bdi", "TPMERC": "market",
          "CODISI": "isin", "PREABE": "open", "PREMAX": "high", "PREMIN": "low", "PREMED": "avg", "PREULT": "close",
          "TOTNEG": "trades", "QUATOT": "quantity", "VOLTOT": "volume"}


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines decoded as Latin-1; the text reader itself always assumes UTF-8."""
    raw = spark.read.format("text").load(path)
    return raw.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))


def split_fields(lines: DataFrame) -> DataFrame:
    """Quote records (type 01) as 26 trimmed text columns; blanks become null."""
    cut = {n: F.nullif(F.trim(F.substring("value", a + 1, e - a)), F.lit("")) for n, a, e in LAYOUT}
    keep = [c for c in lines.columns if c != "value"]
    return lines.filter(F.substring("value", 1, 2) == "01").select(*keep, *[c.alias(n) for n, c in cut.items()])


def typed(records: DataFrame) -> DataFrame:
    """Implied two decimals, tolerant integers, real dates."""
    money = {c: F.expr(f"try_cast({c} AS DECIMAL(18,0))").cast("double") / 100 for c in MONEY}
    ints = {c: F.expr(f"try_cast({c} AS BIGINT)") for c in INTEGERS}
    return records.withColumns({**money, **ints, "DATA": F.try_to_date("DATA", "yyyyMMdd")})


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    t = typed(split_fields(scan_lines(spark, path)))
    return t.select(*[F.col(k).alias(v) for k, v in DOMAIN.items()])


def audit_raw(lines: DataFrame, unit: Column | None = None) -> DataFrame:
    """Per file: widths, record types, one header and one trailer, declared count and its convention.

    ``unit`` names the file of a line; by default the path it was read from.
    """
    unit = F.input_file_name() if unit is None else unit
    kind = F.substring("value", 1, 2)
    a, e = TRAILER_COUNT
    declared = F.expr("try_cast(declared_text AS BIGINT)")
    g = lines.groupBy(unit.alias("unit")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(kind == "01").alias("quotes"), F.count_if(kind == "00").alias("headers"),
        F.count_if(kind == "99").alias("trailers"), F.count_if(~kind.isin("00", "01", "99")).alias("other_types"),
        F.count_if(F.length("value") != LINE_WIDTH).alias("bad_widths"),
        F.max(F.when(kind == "99", F.trim(F.substring("value", a + 1, e - a)))).alias("declared_text"))
    g = g.withColumn("declared", declared).drop("declared_text")
    g = g.withColumn("convention", F.when(F.col("declared") == F.col("lines"), "todas_as_linhas")
                     .when(F.col("declared") == F.col("quotes"), "somente_cotacoes"))
    problem = (F.when(F.col("bad_widths") > 0, "largura").when(F.col("headers") != 1, "header").when(F.col("trailers") != 1, "trailer")
               .when(F.col("other_types") > 0, "tipos").when(F.col("convention").isNull(), "contagem_do_trailer"))
    return g.withColumn("problem", problem)


def require_valid(audit: DataFrame) -> DataFrame:
    """The audit with an error raised on read for any file with a problem."""
    return require(audit, F.col("problem").isNotNull(), F.concat_ws(": ", "unit", "problem"))


def to_lines(quotes: DataFrame) -> DataFrame:
    """Quote records as fixed-width lines."""
    money = lambda c, w: F.lpad(F.floor(F.coalesce(c, F.lit(0.0)) * 100 + 0.5).cast("string"), w, "0")
    source = {v: k for k, v in DOMAIN.items()}
    parts = []
    for name, a, e in LAYOUT:
        w = e - a
        dom = next((d for d, n in source.items() if n == name), None)
        if name == "TIPREG":
            parts.append(F.lit("01"))
        elif name == "DATA":
            parts.append(F.date_format("date", "yyyyMMdd"))
        elif name in MONEY:
            parts.append(money(F.col(dom), w) if dom else F.lit("0" * w))
        elif name in INTEGERS:
            parts.append(F.lpad(F.col(dom).cast("long").cast("string"), w, "0"))
        else:
            parts.append(F.rpad(F.coalesce(F.col(dom), F.lit("")), w, " ") if dom else F.lit(" " * w))
    return quotes.select("*", F.concat(*parts).alias("value"))


def with_frame(lines: DataFrame, unit: str) -> DataFrame:
    """Add the header and trailer of each unit; the trailer counts all lines."""
    n = lines.groupBy(unit).agg((F.count(F.lit(1)) + 2).alias("n"))
    head = n.select(unit, F.rpad(F.lit("00COTAHIST"), LINE_WIDTH, " ").alias("value"))
    tail = n.select(unit, F.rpad(F.concat(F.rpad(F.lit("99COTAHIST"), 31, " "), F.lpad(F.col("n").cast("string"), 11, "0")), LINE_WIDTH, " ").alias("value"))
    return lines.select(unit, "value").unionByName(head).unionByName(tail)
