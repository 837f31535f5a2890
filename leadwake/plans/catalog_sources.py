"""Queries over sources, sinks, contracts and coverage."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from leadwake.operators import coverage, crosscheck, quality, succession, universe
from leadwake.oracle.ctes import define
from leadwake.plans import bindings as b
from leadwake.plans.registry import register
from leadwake.session import shared_folder
from leadwake.sources import files, filing_files, quote_files, tables


def _folder(c, name: str) -> str:
    return f"{shared_folder(c.spark)}/{name}-{uuid.uuid4().hex}"


def _lines(c):
    return quote_files.to_lines(c.daily.withColumn("year", F.year("date")))


def _line_files(c) -> str:
    path = _folder(c, "quotes-text")
    quote_files.with_frame(_lines(c), "year").write.partitionBy("year").text(path)
    return path


CENT = "floor({c} * 100 + 0.5) / 100"
register("src_01_fixed_width_scan", "date:d instrument:s name:s spec:s bdi:s market:s isin:s open:f high:f low:f close:f trades:i quantity:i volume:f",
         lambda c: quote_files.read_quotes(c.spark, _line_files(c)),
         f"""SELECT date, instrument, trim(left(name, 12)) AS name, trim(left(spec, 10)) AS spec, bdi, market, nullif(isin, '') AS isin, {CENT.format(c='open')} AS open, {CENT.format(c='high')} AS high,
               {CENT.format(c='low')} AS low, {CENT.format(c='close')} AS close, trades, quantity::BIGINT AS quantity, {CENT.format(c='volume')} AS volume FROM x_dq""")
register("src_02_typed_fields", "rows:i bad_dates:i bad_trades:i bad_prices:i volume:f",
         lambda c: (quote_files.typed(quote_files.split_fields(_lines(c).select(F.when(F.col("volume") > 120000, F.concat(
             F.substring("value", 1, 147), F.lit("XXXXX"), F.substring("value", 153, 200))).when(F.col("volume") < 3000, F.concat(
                 F.lit("0120011399"), F.substring("value", 11, 240))).otherwise(F.col("value")).alias("value"))))
             .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("DATA").isNull()).alias("bad_dates"), F.count_if(F.col("TOTNEG").isNull()).alias("bad_trades"),
                  F.count_if(F.col("PREULT").isNull()).alias("bad_prices"), F.round(F.sum("VOLTOT"), 2).alias("volume"))),
         """SELECT count(*) AS rows, count(*) FILTER (WHERE volume < 3000) AS bad_dates, count(*) FILTER (WHERE volume > 120000) AS bad_trades, 0 AS bad_prices, round(sum(volume), 2) AS volume FROM x_dq""")
register("src_03_raw_audit", "unit:s lines:i quotes:i headers:i trailers:i other_types:i bad_widths:i declared:i convention:s problem:s",
         lambda c: quote_files.audit_raw(quote_files.scan_lines(c.spark, _line_files(c)), F.col("year").cast("string")),
         """SELECT year(date)::VARCHAR AS unit, count(*) + 2 AS lines, count(*) AS quotes, 1 AS headers, 1 AS trailers, 0 AS other_types, 0 AS bad_widths, count(*) + 2 AS declared,
              'todas_as_linhas' AS convention, NULL AS problem FROM x_dq GROUP BY 1""")


def _stored(c) -> str:
    path = _folder(c, "quotes")
    tables.write_quotes(c.daily, path)
    return path


register("src_07_period_load", "date:d rows:i", lambda c: (tables.load_quotes(c.spark, _stored(c), date(1997, 3, 1), date(1999, 6, 30))
                                                          .groupBy("date").agg(F.count(F.lit(1)).alias("rows"))),
         "SELECT date, count(*) AS rows FROM x_dq WHERE date BETWEEN DATE '1997-03-01' AND DATE '1999-06-30' GROUP BY 1")
register("src_08_checked_store", "year:i rows:i",
         lambda c: tables.store_checked(c.daily, _folder(c, "quotes"), c.table("lineitem").select("l_suppkey", F.to_date("l_shipdate")).distinct().count())
         .groupBy("year").agg(F.count(F.lit(1)).alias("rows")),
         "SELECT year(date) AS year, count(*) AS rows FROM x_dq GROUP BY 1")


def _filing_csv(c) -> str:
    path = _folder(c, "filings")
    (b.filings(c.spark, c.sf).select(*filing_files.FILING_COLUMNS).write.option("sep", ";").option("header", True)
     .option("encoding", "ISO-8859-1").option("emptyValue", "").csv(path))
    return path


register("src_10_filing_csv", "protocol<Protocolo_Entrega:s document_id:s", lambda c: filing_files.read_relevant_facts(c.spark, _filing_csv(c), "ISO-8859-1"),
         """SELECT doc_id::VARCHAR AS protocol, sha256('["' || cnpj || '","EMPRESA ' || doc_id % 25 || '","' || code || '","' || delivered || '","' || category || '","","","' || source || '","' || delivered || '","' ||
              CASE WHEN source = 'src3' THEN 'RE - Reapresentação' ELSE 'AP - Apresentação' END || '","' || doc_id || '","' || CASE WHEN n_chars > 9000 THEN '2' WHEN n_chars > 3000 THEN '1' ELSE '' END || '","https://exemplo/' || doc_id || '"]') AS document_id
            FROM x_fil WHERE category = 'Fato Relevante'""")
register("src_12_leader_reference", "check:s rows:i violations:i",
         lambda c: filing_files.leader_violations(b.instruments(c.spark, c.sf).select(
             F.col("issuer_code").alias("issuer"), F.substring("issuer_code", 2, 3).alias("codigo_cvm"), F.when(F.col("acctbal") < 0, "").otherwise(F.col("issuer_code")).alias("cnpj"),
             F.lit("1995-01-01").alias("valid_from"), F.when(F.col("acctbal") > 9500, "1990-01-01").alias("valid_to"),
             F.when(F.col("acctbal") < 500, "pendente").otherwise("confirmado").alias("review_status"))),
         """SELECT 'celula_vazia' AS "check", count(*) AS rows, count(*) FILTER (WHERE acctbal < 0 OR issuer_code = 'N000') AS violations FROM x_inst
            UNION ALL SELECT 'nao_confirmado', count(*), count(*) FILTER (WHERE acctbal < 500) FROM x_inst UNION ALL SELECT 'validade_invertida', count(*), count(*) FILTER (WHERE acctbal > 9500) FROM x_inst
            UNION ALL SELECT 'issuer_repetido', count(*), count(*) - count(DISTINCT issuer_code) FROM x_inst UNION ALL SELECT 'codigo_cvm_repetido', count(*), count(*) - count(DISTINCT issuer_code) FROM x_inst
            UNION ALL SELECT 'cnpj_repetido', count(*), count(*) - count(DISTINCT CASE WHEN acctbal < 0 THEN '' ELSE issuer_code END) FROM x_inst""")


def _stored_selection(c):
    path = _folder(c, "universe")
    tables.write_table(c.study.selection, path, ("window",))
    return c.spark.read.parquet(path)


register("src_14_partitioned_sink", "win<window:s rows:i", lambda c: _stored_selection(c).groupBy("window").agg(F.count(F.lit(1)).alias("rows")),
         "SELECT win, count(*) AS rows FROM x_sel GROUP BY 1")
def _monthly_files(c) -> str:
    """One file per month with header and trailer, its lines in order.  They are kept packed: lines of fixed width are mostly padding."""
    path = _folder(c, "quotes-months")
    lines = quote_files.with_frame(quote_files.to_lines(c.daily.withColumn("month", F.date_format("date", "yyyy-MM"))), "month")
    lines.repartition("month").sortWithinPartitions("month", "value").write.partitionBy("month").option("compression", "gzip").text(path)
    return path


_PRICE = "lpad(floor({c} * 100 + 0.5)::BIGINT::VARCHAR, {w}, '0')"
register("src_15_file_fingerprints", "unit:s sha256:s bytes:i error:s",
         lambda c: files.fingerprints(c.spark, _monthly_files(c), "*.txt.gz", opener=files.open_unpacked).withColumn("unit", F.regexp_extract("path", "month=([0-9-]+)", 1)),
         f"""SELECT unit, sha256(rpad('00COTAHIST', 245, ' ') || chr(10) || string_agg(line || chr(10), '' ORDER BY line) || rpad(rpad('99COTAHIST', 31, ' ') || lpad((count(*) + 2)::VARCHAR, 11, '0'), 245, ' ') || chr(10)) AS sha256,
               (count(*) + 2) * 246 AS bytes, NULL AS error
             FROM (SELECT strftime(date, '%Y-%m') AS unit, '01' || strftime(date, '%Y%m%d') || rpad(bdi, 2, ' ') || rpad(instrument, 12, ' ') || rpad(market, 3, ' ') || rpad(name, 12, ' ') || rpad(spec, 10, ' ') || repeat(' ', 7) ||
                 {_PRICE.format(c='open', w=13)} || {_PRICE.format(c='high', w=13)} || {_PRICE.format(c='low', w=13)} || {_PRICE.format(c='avg', w=13)} || {_PRICE.format(c='close', w=13)} || repeat('0', 26) || lpad(trades::VARCHAR, 5, '0') ||
                 lpad(quantity::BIGINT::VARCHAR, 18, '0') || {_PRICE.format(c='volume', w=18)} || repeat('0', 13) || repeat(' ', 29) || rpad(coalesce(isin, ''), 12, ' ') || '   ' AS line FROM x_dq) GROUP BY 1""")
register("src_16_pdf_signature", "doc_id:i anywhere:b at_start:b",
         lambda c: c.table("documents").withColumn("content", F.encode(F.when(F.col("lang") == "en", F.concat(F.lit("  %PDF-1.4\n"), "text")).when(
             F.col("lang") == "fr", F.concat(F.lit("lixo %PDF-1.4\n"), "text")).otherwise(F.col("text")), "UTF-8")).select(
             "doc_id", files.pdf_signature(F.col("content")).alias("anywhere"), files.pdf_at_start(F.col("content")).alias("at_start")),
         "SELECT doc_id, lang IN ('en', 'fr') AS anywhere, lang = 'en' AS at_start FROM documents")

# ---- contracts on stored results ------------------------------------------------------------
register("uni_10_universe_contract", "check:s rows:i violations:i",
         lambda c: tables.universe_contract(_stored_selection(c), 25, c.study.windows),
         """WITH g AS (SELECT w.win, count(s.win) AS n, count(DISTINCT issuer) AS i, count(DISTINCT final_position) AS p FROM x_win w LEFT JOIN x_sel s ON s.win = w.win AND s.reason = '' AND s.final_position <= 25 GROUP BY 1)
            SELECT 'nomes_por_janela' AS "check", count(*) AS rows, count(*) FILTER (WHERE n <> 25) AS violations FROM g UNION ALL SELECT 'emissores_distintos', count(*), count(*) FILTER (WHERE i <> n) FROM g
            UNION ALL SELECT 'posicoes_completas', count(*), count(*) FILTER (WHERE p <> 25) FROM g""")
register("uni_11_pair_contract", "check:s rows:i violations:i",
         lambda c: tables.pairs_contract(c.study.all_pairs).unionByName(tables.network_contract(c.study.controlled)),
         """SELECT 'mesmo_emissor' AS "check", count(*) AS rows, 0 AS violations FROM x_pairs UNION ALL SELECT 'par_proprio', count(*), 0 FROM x_pairs UNION ALL SELECT 'aresta_repetida', count(*), 0 FROM x_pairs
            UNION ALL SELECT 'beta_ausente', count(*), count(*) FILTER (WHERE beta IS NULL) FROM x_net UNION ALL SELECT 'beta_repetido', count(*), 0 FROM x_net""")
register("uni_12_pairs_with_betas", "win<window:s leader:s follower:s beta:f t_stat:f n:i", lambda c: tables.pairs_with_betas(c.study.all_pairs, c.study.controlled)[0],
         "SELECT win, leader, follower, beta, t_stat, n FROM x_net")
register("src_13_checked_results", "check:s rows:i violations:i", lambda c: tables.pairs_with_betas(c.study.all_pairs, c.study.controlled.filter("beta > 0"))[1],
         """SELECT 'par_sem_beta' AS "check", count(*) FILTER (WHERE coalesce(beta, 0) <= 0) AS rows, count(*) FILTER (WHERE coalesce(beta, 0) <= 0) AS violations FROM x_net UNION ALL SELECT 'beta_sem_par', 0, 0""")

# ---- coverage and queues --------------------------------------------------------------------
register("dq_13_validation_retry", "old:s state:s overlap:i correlation:f terminal:s",
         lambda c: crosscheck.validate_with_terminal(
             c.daily, b.reference_prices(c.spark, c.sf),
             b.instruments(c.spark, c.sf).select(F.col("instrument").alias("old"), F.when(F.col("acctbal") < 3000, F.concat(F.lit("X"), "instrument")).otherwise(F.col("instrument")).alias("new")),
             b.instruments(c.spark, c.sf).select("instrument", F.col("instrument").alias("terminal"))),
         "SELECT old, state, overlap, correlation, CASE WHEN acctbal < 3000 THEN old END AS terminal FROM x_valid v JOIN x_inst i ON i.instrument = v.old")


def _missing(c):
    q = b.coded_quotes(c.spark, c.sf).withColumn("isin", F.concat(F.lit("BR"), F.substring("name", 15, 4), F.lit("ACNOR0")))
    ends = succession.series_ends(q)
    states = ends.select("instrument", F.when(F.col("last_price") > 250000, "serie_vazia").otherwise("sucesso").alias("state"))
    best = ends.filter("first_price > 100000").select("instrument", F.floor(F.col("first_price") / 5000).alias("best_position"))
    return coverage.missing_series(q, states, succession.linked_codes(ends), best, (20, 40, 60, 100))


define("x_miss", """
SELECT *, CASE WHEN band IN ('nunca_elegivel', 'fora_das_faixas') THEN 'nao_material' WHEN cause = 'encerrado_com_sucessor_no_detector' THEN 'revisao_documental_mudanca_ticker'
  WHEN cause = 'encerrado_com_outra_classe_do_emissor' THEN 'conversao_classe_documentada' ELSE 'preco_bruto_cotahist' END AS route
FROM (SELECT e.instrument, CASE WHEN last_date >= m.d - 30 AND first_date >= m.d - INTERVAL 12 MONTH THEN 'instrumento_recente_sem_serie_ainda' WHEN last_date >= m.d - 30 THEN 'ativo_no_fim_sem_serie'
    WHEN e.instrument IN (SELECT old FROM x_cand UNION SELECT new FROM x_cand) THEN 'encerrado_com_sucessor_no_detector'
    WHEN substr(e.name, 15, 4) IN (SELECT substr(name, 15, 4) FROM x_ends WHERE last_price <= 250000) THEN 'encerrado_com_outra_classe_do_emissor' ELSE 'encerrado_sem_sucessor_no_universo' END AS cause,
    CASE WHEN first_price <= 100000 THEN 'nunca_elegivel' WHEN floor(first_price / 5000) <= 20 THEN 'top20' WHEN floor(first_price / 5000) <= 40 THEN 'top40' WHEN floor(first_price / 5000) <= 60 THEN 'top60'
      WHEN floor(first_price / 5000) <= 100 THEN 'top100' ELSE 'fora_das_faixas' END AS band
  FROM x_ends e CROSS JOIN (SELECT max(date) AS d FROM x_cq) m WHERE last_price > 250000)""")
register("dq_14_missing_series", "instrument:s cause:s band:s route:s", _missing, "SELECT * FROM x_miss")
register("dq_15_cause_by_band", "cause:s band:s instruments:i", lambda c: coverage.cause_by_band(_missing(c)), "SELECT cause, band, count(*) AS instruments FROM x_miss GROUP BY 1, 2")
register("dq_17_coverage_by_decile", "decile:i instruments:i mean_coverage:f median_coverage:f",
         lambda c: coverage.coverage_by_decile(
             crosscheck.source_coverage(c.daily, b.reference_prices(c.spark, c.sf), b.instruments(c.spark, c.sf).select(
                 "instrument", F.lit(False).alias("failed"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("terminal"))).select("instrument", "coverage"),
             c.daily.groupBy("instrument").agg(F.median("volume").alias("median_volume"))),
         """SELECT greatest(ceil((rk - 1) * 10 / greatest(n - 1, 1)), 1) AS decile, count(*) AS instruments, avg(coverage) AS mean_coverage, median(coverage) AS median_coverage
            FROM (SELECT *, row_number() OVER (ORDER BY mv, instrument) AS rk, count(*) OVER () AS n FROM (
              SELECT q.instrument, count(r.date) / count(q.date) AS coverage, median(q.volume) AS mv FROM x_dq q LEFT JOIN x_ref r ON r.instrument = q.instrument AND r.date = q.date GROUP BY 1)) GROUP BY 1""")
register("dq_26_filing_summary", "year:s filings:i facts:i outside_horizon:i", lambda c: coverage.filing_summary(b.filings(c.spark, c.sf), 1998, 2000),
         """SELECT year(delivered)::VARCHAR AS year, count(*) AS filings, count(*) FILTER (WHERE category = 'Fato Relevante') AS facts, count(*) FILTER (WHERE year(delivered) NOT BETWEEN 1998 AND 2000) AS outside_horizon FROM x_fil GROUP BY 1""")
register("dq_26_leader_coverage", "issuer:s filings:i first:d last:d", lambda c: coverage.leader_coverage(b.filings(c.spark, c.sf)),
         "SELECT issuer, count(*) AS filings, min(delivered) AS first, max(delivered) AS last FROM x_fil GROUP BY 1")
register("sec_05_curation_queue", "instrument:s best_position:i route:s instruments:i split_issuer:b confirmed:b",
         lambda c: coverage.curation_queue(universe.best_positions(c.study.selection), c.daily, c.sectors, 60, 3),
         """WITH q AS (SELECT r.instrument, min(position) AS best_position FROM x_rank r WHERE eligible GROUP BY 1 HAVING min(position) <= 60),
                 p AS (SELECT q.*, CASE WHEN length(isin) = 12 THEN substr(isin, 3, 4) ELSE '' END AS issuer, CASE WHEN ld >= (SELECT max(date) FROM x_dq) - 3 THEN 'listagem_atual' ELSE 'arquivo_historico' END AS route
                       FROM q JOIN (SELECT instrument, max(date) AS ld, any_value(isin) AS isin FROM x_dq GROUP BY 1) d ON d.instrument = q.instrument)
            SELECT p.instrument, best_position, route, count(*) OVER (PARTITION BY issuer) AS instruments, min(route) OVER (PARTITION BY issuer) <> max(route) OVER (PARTITION BY issuer) AS split_issuer,
                   p.instrument IN (SELECT instrument FROM x_sect WHERE review_status = 'confirmado') AS confirmed FROM p""")
register("rpt_03_expected_results", "name:s expected:f value:f passed:b",
         lambda c: coverage.expectations(c.study.selection.agg(F.count_distinct("window").alias("janelas"), F.max("final_position").alias("maior_posicao")), {"janelas": 19, "maior_posicao": 25}),
         """SELECT name, expected, value, expected = value AS passed FROM (SELECT 'janelas' AS name, 19 AS expected, (SELECT count(DISTINCT win) FROM x_sel) AS value
            UNION ALL SELECT 'maior_posicao', 25, (SELECT max(final_position) FROM x_sel))""")
