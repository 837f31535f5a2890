"""Queries over label quality: sampling, agreement, gold and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadwake.operators import agreement, digest, sampling
from leadwake.oracle.ctes import define
from leadwake.plans import bindings as b
from leadwake.plans.registry import register

define("x_votes", """
SELECT doc_id, rater, CASE WHEN draw < 4 THEN (['nao_especifico', 'especifico_positiva', 'especifico_negativa', 'especifico_neutra'])[draw + 1] ELSE base END AS class
FROM (SELECT doc_id, rater, CASE WHEN specific THEN 'especifico_' || direction ELSE 'nao_especifico' END AS base,
             ('0x' || substr(md5(concat_ws('|', 'voto', rater, doc_id)), 1, 8))::BIGINT % 20 AS draw
      FROM x_lab CROSS JOIN (SELECT unnest(['r1', 'r2', 'r3', 'r4', 'r5']) AS rater) WHERE status = 'ok')""")
define("x_ab", """
SELECT a.doc_id, a.class AS class_a, b.class AS class_b FROM x_votes a JOIN x_votes b ON a.doc_id = b.doc_id AND a.rater = 'r1' AND b.rater = 'r2'""")
define("x_gold", """
SELECT doc_id, CASE WHEN top >= 3 THEN win ELSE tb END AS gold, CASE WHEN top = 5 THEN 'unanime' WHEN top >= 3 THEN 'maioria' ELSE 'desempate' END AS origin,
       CASE WHEN top >= 3 THEN top ELSE tbn END AS votes
FROM (SELECT doc_id, max(n) AS top, arg_max(class, n) AS win, max(class) FILTER (WHERE t) AS tb, max(n) FILTER (WHERE t) AS tbn
      FROM (SELECT doc_id, class, count(*) AS n, bool_or(rater = 'r3') AS t FROM x_votes GROUP BY 1, 2) GROUP BY 1)""")
define("x_pred", "SELECT doc_id, CASE WHEN specific THEN 'especifico_' || direction ELSE 'nao_especifico' END AS class, NOT specific OR direction = 'neutra' AS abstain FROM x_lab WHERE status = 'ok'")
CLS = "(SELECT unnest(['nao_especifico', 'especifico_positiva', 'especifico_negativa', 'especifico_neutra']) AS c)"
define("x_conf", f"""
SELECT g.c AS gold, p.c AS predicted, count(x.doc_id) AS n FROM {CLS} g CROSS JOIN {CLS} p
LEFT JOIN (SELECT x.doc_id, gold, class FROM x_gold x JOIN x_pred y ON x.doc_id = y.doc_id) x ON x.gold = g.c AND x.class = p.c GROUP BY 1, 2""")
define("x_cm", """
SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc FROM (
    SELECT c.gold AS class, sum(n) FILTER (WHERE predicted = gold) AS tp, sum(n) AS support, (SELECT sum(n) FROM x_conf k WHERE k.predicted = c.gold) AS predicted FROM x_conf c GROUP BY 1))""")
define("x_kappa", """
SELECT n, observed, expected, (observed - expected) / (1 - expected) AS kappa FROM (
  SELECT count(*) AS n, avg((class_a = class_b)::INT) AS observed,
         (SELECT sum(pa * pb) FROM (SELECT class_a AS c, count(*) / (SELECT count(*) FROM x_ab) AS pa FROM x_ab GROUP BY 1) JOIN (SELECT class_b AS c, count(*) / (SELECT count(*) FROM x_ab) AS pb FROM x_ab GROUP BY 1) USING (c)) AS expected FROM x_ab)""")


def _ab(c):
    return agreement.align_raters(b.rater(c.spark, c.sf, "r1"), b.rater(c.spark, c.sf, "r2"))


def _gold(c):
    return agreement.majority_gold(b.votes(c.spark, c.sf), 5, "r3")


def _pred(c):
    return (b.document_labels(c.spark, c.sf).filter("status = 'ok'")
            .select("doc_id", agreement.joint_class(F.col("specific"), F.col("direction")).alias("class"),
                    (~F.col("specific") | (F.col("direction") == "neutra")).alias("abstain")))


def _matrix(c):
    return agreement.confusion(_pred(c), _gold(c).select("doc_id", "gold"))


def _sample_input(c):
    f = b.filings(c.spark, c.sf).select("doc_id", "issuer", F.year("delivered").alias("year"))
    return f.join(b.document_labels(c.spark, c.sf).filter("status = 'ok'"), "doc_id").select("doc_id", "issuer", "year", "direction", "specific")


def _contract(c):
    d = c.table("documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    lab = (b.document_labels(c.spark, c.sf).join(c.table("documents").select("doc_id", "text", "n_chars"), "doc_id")
           .select("doc_id", "status", "specific", "direction", ((F.col("direction") == "neutra") | ~F.col("specific")).alias("abstain"),
                   F.when(F.col("n_chars") > 15000, "velho").otherwise(F.sha2("text", 256)).alias("text_hash")))
    return agreement.label_contract(d, lab.filter("direction is not null or text_hash <> 'velho'"))


register("evl_01_label_contract", "check:s rows:i violations:i", _contract,
         """WITH l AS (SELECT x.*, n_chars FROM x_lab x JOIN documents d ON d.doc_id = x.doc_id WHERE direction IS NOT NULL OR n_chars <= 15000)
            SELECT 'documento_sem_rotulo' AS "check", (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents) - (SELECT count(*) FROM l) AS violations
            UNION ALL SELECT 'rotulo_sem_documento', (SELECT count(*) FROM documents), 0 UNION ALL SELECT 'hash_de_texto_diferente', (SELECT count(*) FROM documents), (SELECT count(*) FROM l WHERE n_chars > 15000)
            UNION ALL SELECT 'status_desconhecido', (SELECT count(*) FROM l), 0 UNION ALL SELECT 'abstencao_incoerente', (SELECT count(*) FROM l WHERE status = 'ok'), 0
            UNION ALL SELECT 'nao_especifico_com_direcao', (SELECT count(*) FROM l WHERE status = 'ok'), 0""")
_BATCH = ("doc_id", "status", "specific", "direction")
register("evl_01_batch_digest", "rows:i digest:s", lambda c: digest.table_digest(b.document_labels(c.spark, c.sf), list(_BATCH)),
         f"""WITH r AS (SELECT sha256(concat_ws(';', {', '.join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in _BATCH)})) AS name FROM x_lab),
                 n AS (SELECT name, count(*) AS rows FROM r GROUP BY 1),
                 a AS (SELECT left(name, 9) AS name, sum(rows) AS n, sha256(string_agg(name || ':' || rows || ':', ',' ORDER BY name)) AS d FROM n GROUP BY 1),
                 b AS (SELECT left(name, 6) AS p, sum(n) AS n, sha256(string_agg(name || ':' || n || ':' || d, ',' ORDER BY name)) AS d FROM a GROUP BY 1),
                 c AS (SELECT left(p, 3) AS q, sum(n) AS n, sha256(string_agg(p || ':' || n || ':' || d, ',' ORDER BY p)) AS d FROM b GROUP BY 1)
            SELECT sum(n) AS rows, sha256(string_agg(q || ':' || n || ':' || d, ',' ORDER BY q)) AS digest FROM c""")
# The greedy sample has no SQL form; tests compare it with brute force.
register("evl_02_blind_sample", "doc_id:i issuer:s year:i direction:s sample_order:i", lambda c: sampling.blind_sample(_sample_input(c), 30, 20260811), None)
register("evl_03_rater_sheets", "doc_id:i anon_id:s rater:s position:i",
         lambda c: sampling.rater_sheets(c.table("labels"), ("A", "B"), 20260811),
         """SELECT doc_id, 'VH-' || upper(substr(sha256('20260811|' || doc_id), 1, 12)) AS anon_id, rater,
              row_number() OVER (PARTITION BY rater ORDER BY md5(concat_ws('|', '20260811', rater, doc_id))) AS position FROM labels CROSS JOIN (SELECT unnest(['A', 'B']) AS rater)""")


def _sheet(c):
    v = b.rater(c.spark, c.sf, "r1").join(c.table("documents").select("doc_id", "n_chars"), "doc_id")
    anon = F.concat(F.lit(" vh-"), F.lower(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12)))
    return v.select("doc_id", anon.alias("id_anonimo"), F.when(F.col("n_chars") % 9 == 0, "talvez").when(F.col("specific"), " Sim").otherwise("NAO").alias("especifico"),
                    F.initcap("direction").alias("direcao"))


register("evl_04_normalized_sheet", "doc_id:i anon_id:s specific:b direction:s problem:s",
         lambda c: agreement.normalize_sheet(_sheet(c), {"id_anonimo": "anon_id", "especifico": "specific", "direcao": "direction"}),
         """SELECT v.doc_id, 'VH-' || upper(substr(sha256(v.doc_id::VARCHAR), 1, 12)) AS anon_id, CASE WHEN n_chars % 9 <> 0 THEN class <> 'nao_especifico' END AS specific,
              CASE WHEN class = 'nao_especifico' THEN 'neutra' ELSE substr(class, 12) END AS direction, CASE WHEN n_chars % 9 = 0 THEN 'booleano_invalido' END AS problem
            FROM x_votes v JOIN documents d ON d.doc_id = v.doc_id WHERE rater = 'r1'""")
register("evl_05_order_permutations", "rater:s rows:i distinct_positions:i first:i last:i",
         lambda c: agreement.confirm_permutation(sampling.rater_sheets(c.table("labels"), ("A", "B"), 20260811)),
         "SELECT rater, count(*) AS rows, count(*) AS distinct_positions, 1 AS first, count(*) AS last FROM labels CROSS JOIN (SELECT unnest(['A', 'B']) AS rater) GROUP BY 1")
register("evl_06_sheet_diff", "original_rows:i returned_rows:i missing_ids:i extra_ids:i changed_texts:i filled:i",
         lambda c: agreement.sheet_diff(
             c.table("documents").select(F.col("doc_id").cast("string").alias("anon_id"), "text"),
             c.table("documents").join(c.table("labels"), "doc_id").select(
                 F.col("doc_id").cast("string").alias("anon_id"), F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
                 F.when(F.col("quality") == 1, "positiva").otherwise("").alias("direction"))),
         """SELECT (SELECT count(*) FROM documents) AS original_rows, count(*) AS returned_rows, (SELECT count(*) FROM documents) - count(*) AS missing_ids, 0 AS extra_ids,
              count(*) FILTER (WHERE toxic = 1) AS changed_texts, count(*) FILTER (WHERE quality = 1) AS filled FROM labels""")
register("evl_07_aligned_raters", "doc_id:i class_a:s class_b:s", _ab, "SELECT * FROM x_ab")
register("evl_08_cohen_kappa", "n:i observed:f expected:f kappa:f", lambda c: agreement.cohen_kappa(_ab(c)), "SELECT * FROM x_kappa")
register("evl_09_fleiss_kappa", "documents:i observed:f expected:f kappa:f", lambda c: agreement.fleiss_kappa(b.votes(c.spark, c.sf), 5),
         """SELECT documents, observed, expected, (observed - expected) / (1 - expected) AS kappa FROM (
              SELECT (SELECT count(DISTINCT doc_id) FROM x_votes) AS documents, (SELECT avg((s - 5) / 20) FROM (SELECT doc_id, sum(n * n) AS s FROM (SELECT doc_id, class, count(*) AS n FROM x_votes GROUP BY 1, 2) GROUP BY 1)) AS observed,
                     (SELECT sum((n / (SELECT count(*) FROM x_votes))^2) FROM (SELECT class, count(*) AS n FROM x_votes GROUP BY 1)) AS expected)""")
register("evl_10_majority_gold", "doc_id:i gold:s origin:s votes:i", _gold, "SELECT * FROM x_gold")
register("evl_11_divergences", "doc_id:i class_a:s class_b:s", lambda c: agreement.divergences(_ab(c)), "SELECT * FROM x_ab WHERE class_a <> class_b")
register("evl_11_adjudicated_gold", "doc_id:i gold:s origin:s",
         lambda c: agreement.adjudicated_gold(_ab(c), b.rater(c.spark, c.sf, "r3").filter("direction <> 'negativa'").select(
             "doc_id", F.col("specific").alias("gold_specific"), F.col("direction").alias("gold_direction"))),
         """SELECT x.doc_id, CASE WHEN class_a = class_b THEN class_a ELSE r.class END AS gold, CASE WHEN class_a = class_b THEN 'consenso' WHEN r.class IS NOT NULL THEN 'adjudicado' ELSE 'pendente' END AS origin
            FROM x_ab x LEFT JOIN (SELECT * FROM x_votes WHERE rater = 'r3' AND class <> 'especifico_negativa') r ON r.doc_id = x.doc_id""")
register("evl_12_confusion", "gold:s predicted:s n:i", _matrix, "SELECT * FROM x_conf")
register("evl_12_class_metrics", "class:s tp:i fp:i fn:i support:i predicted:i precision:f recall:f f1:f enough_support:b", lambda c: agreement.class_metrics(_matrix(c)),
         "SELECT *, predicted - tp AS fp, support - tp AS fn, pr AS precision, rc AS recall, support >= 10 AS enough_support FROM x_cm")
register("evl_12_evaluation", "documents:i abstentions:i coverage:f abstention_rate:f macro_f1:f macro_f1_supported:f supported:i kappa:f passed_f1:b passed_kappa:b passed:b",
         lambda c: agreement.evaluation(agreement.class_metrics(_matrix(c)), _pred(c), agreement.cohen_kappa(_ab(c))),
         """SELECT *, passed_f1 AND passed_kappa AS passed FROM (SELECT documents, abstentions, 1 - abstentions / documents AS coverage, abstentions / documents AS abstention_rate, macro_f1, ms AS macro_f1_supported, supported, kappa,
              ms >= 0.7 AND supported >= 2 AND mn > 0 AS passed_f1, kappa >= 0.6 AS passed_kappa
            FROM (SELECT avg(f1) AS macro_f1, avg(f1) FILTER (WHERE support >= 10) AS ms, count(*) FILTER (WHERE support >= 10) AS supported, least(min(support), min(predicted)) AS mn FROM x_cm),
                 (SELECT count(*) AS documents, count(*) FILTER (WHERE abstain) AS abstentions FROM x_pred), x_kappa)""")
register("evl_13_pairwise_agreement", "rater_a:s rater_b:s agreement:f documents:i", lambda c: agreement.pairwise_agreement(b.votes(c.spark, c.sf)),
         "SELECT a.rater AS rater_a, b.rater AS rater_b, avg((a.class = b.class)::INT) AS agreement, count(*) AS documents FROM x_votes a JOIN x_votes b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY 1, 2")
register("evl_14_directional_counts", "rater:s positiva:i negativa:i neutra:i nao_especifico:i", lambda c: agreement.directional_counts(b.votes(c.spark, c.sf)),
         """SELECT rater, count(*) FILTER (WHERE class = 'especifico_positiva') AS positiva, count(*) FILTER (WHERE class = 'especifico_negativa') AS negativa,
              count(*) FILTER (WHERE class = 'especifico_neutra') AS neutra, count(*) FILTER (WHERE class = 'nao_especifico') AS nao_especifico FROM x_votes GROUP BY 1""")
register("evl_15_panel_summary", "origin:s gold:s documents:i", lambda c: _gold(c).groupBy("origin", "gold").agg(F.count(F.lit(1)).alias("documents")),
         "SELECT origin, gold, count(*) AS documents FROM x_gold GROUP BY 1, 2")
register("flt_10_blinded_columns", "doc_id:i issuer:s columns:s",
         lambda c: (lambda d: d.withColumn("columns", F.lit(",".join(d.columns))))(sampling.blind(_sample_input(c).withColumnsRenamed(
             {"direction": "Direção", "specific": "especifico_empresa"}).withColumns({"retorno_5d": F.lit(0.1), "preco_futuro": F.lit(1.0), "prompt_hash": F.lit("x")}))),
         "SELECT l.doc_id, issuer, 'doc_id,issuer,year' AS columns FROM x_lab l JOIN x_fil f ON f.doc_id = l.doc_id WHERE status = 'ok'")
