"""Rater agreement, gold labels and classifier evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadwake.operators.checks import require

# Joint classes and gate limits.
JOINT_CLASSES = ("nao_especifico", "especifico_positiva", "especifico_negativa", "especifico_neutra")
MIN_MACRO_F1, MIN_KAPPA, MIN_SUPPORT, MIN_SUPPORTED_CLASSES = 0.70, 0.60, 10, 2
TRUE_TOKENS, FALSE_TOKENS = ("sim", "s", "true", "verdadeiro", "1"), ("nao", "não", "n", "false", "falso", "0")
DIRECTIONS = ("positiva", "negativa", "neutra")


def joint_class(specific: Column, direction: Column) -> Column:
    """Null where the answer itself is missing."""
    return F.when(specific, F.concat(F.lit("especifico_"), direction)).when(~specific, "nao_especifico")


def normalize_sheet(sheet: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Header aliases, boolean and direction tokens; a bad cell becomes a named problem."""
    for a, name in aliases.items():
        if a in sheet.columns:
            sheet = sheet.withColumnRenamed(a, name)
    tok = F.lower(F.trim("specific"))
    spec = F.when(tok.isin(*TRUE_TOKENS), True).when(tok.isin(*FALSE_TOKENS), False)
    direction = F.lower(F.trim("direction"))
    out = sheet.withColumns({"anon_id": F.upper(F.trim("anon_id")), "specific": spec, "direction": F.when(direction.isin(*DIRECTIONS), direction)})
    return out.withColumn("problem", F.when(~F.coalesce(F.col("anon_id").rlike("^VH-[0-9A-F]{12}$"), F.lit(False)), "id_invalido")
                          .when(F.col("specific").isNull(), "booleano_invalido").when(F.col("direction").isNull(), "direcao_invalida")
                          .when(~F.col("specific") & (F.col("direction") != "neutra"), "nao_especifico_com_direcao"))


def sheet_diff(original: DataFrame, returned: DataFrame) -> DataFrame:
    """Row counts, ids on one side only, changed texts, filled answers: one row."""
    o = original.select("anon_id", F.col("text").alias("t0"), F.lit(True).alias("a"))
    r = returned.select("anon_id", F.col("text").alias("t1"), F.col("direction").alias("d"), F.lit(True).alias("b"))
    return o.join(r, "anon_id", "full").agg(
        F.count("a").alias("original_rows"), F.count("b").alias("returned_rows"), F.count_if(F.col("b").isNull()).alias("missing_ids"),
        F.count_if(F.col("a").isNull()).alias("extra_ids"), F.count_if(F.col("a") & F.col("b") & ~F.col("t0").eqNullSafe(F.col("t1"))).alias("changed_texts"),
        F.count_if(F.trim("d") != "").alias("filled"))


def align_raters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two raters' labels side by side; ids on one side only are an error raised on read."""
    x = a.select("doc_id", F.col("specific").alias("specific_a"), F.col("direction").alias("direction_a"))
    y = b.select("doc_id", F.col("specific").alias("specific_b"), F.col("direction").alias("direction_b"))
    j = x.join(y, "doc_id", "full")
    one_sided = F.col("specific_a").isNull() | F.col("specific_b").isNull()
    j = require(j, one_sided, F.concat(F.lit("id labelled by one rater only: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return j.withColumns({"class_a": joint_class(F.col("specific_a"), F.col("direction_a")), "class_b": joint_class(F.col("specific_b"), F.col("direction_b"))})


def cohen_kappa(aligned: DataFrame) -> DataFrame:
    """Contingency first (at most 16 rows), marginals from it; null when chance agreement is one."""
    t = aligned.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("n"))
    sides = t.select(F.explode(F.array(
        F.struct(F.col("class_a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("class_b").alias("c"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("s"))
    m = sides.groupBy("s.c").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    tot = t.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class_a") == F.col("class_b"), F.col("n")).otherwise(0)).alias("same"), F.lit(1).alias("k"))
    exp = m.agg(F.sum(F.col("na") * F.col("nb")).alias("cross"), F.lit(1).alias("k"))
    j = tot.join(exp, "k")
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return j.select("n", po.alias("observed"), pe.alias("expected"), F.when(F.abs(pe - 1) > 1e-15, (po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(votes: DataFrame, raters: int) -> DataFrame:
    """``votes``: doc_id, rater, class.  Counts per document and class, then two small aggregates."""
    c = votes.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))
    doc = c.groupBy("doc_id").agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("agree"))
    obs = doc.agg(F.avg("agree").alias("observed"), F.count(F.lit(1)).alias("documents"), F.lit(1).alias("k"))
    cls = c.groupBy("class").agg(F.sum("n").alias("n"))
    exp = cls.agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("total"), F.lit(1).alias("k"))
    pe = F.col("sq") / (F.col("total") * F.col("total"))
    return obs.join(exp, "k").select("documents", "observed", pe.alias("expected"),
                                     F.when(F.abs(pe - 1) > 1e-15, (F.col("observed") - pe) / (1 - pe)).alias("kappa"))


def majority_gold(votes: DataFrame, raters: int, tie_break: str) -> DataFrame:
    """Strict majority wins; otherwise the declared rater's class."""
    c = votes.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("rater") == tie_break).alias("tb"))
    need = raters // 2 + 1
    top = c.groupBy("doc_id").agg(F.max(F.struct("n", "class")).alias("top"), F.max(F.when(F.col("tb"), F.struct("class", "n"))).alias("tie"))
    won = F.col("top.n") >= need
    out = top.select("doc_id", F.when(won, F.col("top.class")).otherwise(F.col("tie.class")).alias("gold"),
                     F.when(F.col("top.n") == raters, "unanime").when(won, "maioria").otherwise("desempate").alias("origin"),
                     F.when(won, F.col("top.n")).otherwise(F.col("tie.n")).alias("votes"), F.lit(raters).alias("raters"))
    return out.withColumns({"specific": F.col("gold") != "nao_especifico", "direction": F.when(
        F.col("gold") == "nao_especifico", "neutra").otherwise(F.regexp_replace("gold", "^especifico_", ""))})


def divergences(aligned: DataFrame) -> DataFrame:
    """Disagreements, with blank gold columns for adjudication."""
    return aligned.filter(F.col("class_a") != F.col("class_b")).withColumns(
        {"gold_specific": F.lit(None).cast("boolean"), "gold_direction": F.lit(None).cast("string")})


def adjudicated_gold(aligned: DataFrame, adjudication: DataFrame) -> DataFrame:
    """Agreed class, else the adjudicated one; what is still open is ``pendente``."""
    adj = adjudication.select("doc_id", joint_class(F.col("gold_specific"), F.col("gold_direction")).alias("ruled"))
    j = aligned.join(adj, "doc_id", "left")
    same = F.col("class_a") == F.col("class_b")
    return j.select("doc_id", F.when(same, F.col("class_a")).otherwise(F.col("ruled")).alias("gold"),
                    F.when(same, "consenso").when(F.col("ruled").isNotNull(), "adjudicado").otherwise("pendente").alias("origin"))


def confusion(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """All 16 cells, including empty ones.  ``predicted``: doc_id, class; ``gold``: doc_id, gold."""
    spark = gold.sparkSession
    cells = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a in JOINT_CLASSES for b in JOINT_CLASSES) + " AS t(gold, predicted)")
    n = gold.join(predicted.select("doc_id", F.col("class").alias("predicted")), "doc_id").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 (zero where undefined) and whether the support is enough."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("gold").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("t")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x"))
    m = sides.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.t").alias("tp"), F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"))
    pr, rc = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    m = m.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "precision": pr, "recall": rc})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return m.withColumn("f1", f1).withColumn("enough_support", F.col("support") >= MIN_SUPPORT)


def evaluation(metrics: DataFrame, predictions: DataFrame, kappa: DataFrame) -> DataFrame:
    """Macro F1 (all, supported), coverage, abstention, and the gate: one row."""
    ok = F.col("enough_support")
    g = metrics.agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(ok, F.col("f1"))).alias("macro_f1_supported"), F.count_if(ok).alias("supported"),
                    F.min("support").alias("mins"), F.min("predicted").alias("minp"), F.lit(1).alias("k"))
    p = predictions.agg(F.count(F.lit(1)).alias("documents"), F.count_if("abstain").alias("abstentions"), F.lit(1).alias("k"))
    e = g.join(p, "k").join(kappa.select("kappa", F.lit(1).alias("k")), "k")
    f1_ok = F.coalesce((F.col("macro_f1_supported") >= MIN_MACRO_F1) & (F.col("supported") >= MIN_SUPPORTED_CLASSES) & (F.col("mins") > 0) & (F.col("minp") > 0), F.lit(False))
    k_ok = F.coalesce(F.col("kappa") >= MIN_KAPPA, F.lit(False))
    return e.select("documents", "abstentions", (1 - F.col("abstentions") / F.col("documents")).alias("coverage"),
                    (F.col("abstentions") / F.col("documents")).alias("abstention_rate"), "macro_f1", "macro_f1_supported", "supported", "kappa",
                    f1_ok.alias("passed_f1"), k_ok.alias("passed_kappa"), (f1_ok & k_ok).alias("passed"))


def pairwise_agreement(votes: DataFrame) -> DataFrame:
    """Share of equal classes per pair of raters; raters per document are few."""
    a = votes.select("doc_id", F.col("rater").alias("rater_a"), F.col("class").alias("ca"))
    b = votes.select("doc_id", F.col("rater").alias("rater_b"), F.col("class").alias("cb"))
    return (a.join(b, "doc_id").filter(F.col("rater_a") < F.col("rater_b")).groupBy("rater_a", "rater_b")
            .agg(F.avg((F.col("ca") == F.col("cb")).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("documents")))


def directional_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("rater").agg(*[F.count_if(F.col("class") == f"especifico_{d}").alias(d) for d in DIRECTIONS],
                                      F.count_if(F.col("class") == "nao_especifico").alias("nao_especifico"))


def label_contract(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Coverage both ways, status vocabulary, abstention invariants, text hashes: (check, rows, violations)."""
    from leadwake.operators.checks import check
    d, lab = documents.select("doc_id", "text_hash"), labels
    both = d.join(lab.select("doc_id", F.col("text_hash").alias("label_hash")), "doc_id", "full")
    sizes = both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_hash").isNull()).alias("a"), F.count_if(F.col("text_hash").isNull()).alias("b"),
                     F.count_if(F.col("text_hash") != F.col("label_hash")).alias("c"))
    spread = sizes.select("rows", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).alias("violations")) for n, c in (
        ("documento_sem_rotulo", "a"), ("rotulo_sem_documento", "b"), ("hash_de_texto_diferente", "c"))])).alias("s")).select("s.check", "rows", "s.violations")
    ok = F.col("status") == "ok"
    should = ~F.col("specific") | (F.col("direction") == "neutra")
    return reduce(DataFrame.unionByName, [
        spread, check(lab, "status_desconhecido", ~F.coalesce(F.col("status").isin("ok", "erro"), F.lit(False))),
        check(lab, "abstencao_incoerente", F.col("abstain") != should, ok),
        check(lab, "nao_especifico_com_direcao", ~F.col("specific") & (F.col("direction") != "neutra"), ok)])


def confirm_permutation(orders: DataFrame) -> DataFrame:
    """Each rater's order is 1..n without gaps: sum, min, max and distinct count agree."""
    return orders.groupBy("rater").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("position").alias("distinct_positions"),
                                       F.min("position").alias("first"), F.max("position").alias("last"))
