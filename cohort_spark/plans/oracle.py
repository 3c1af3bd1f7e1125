"""DuckDB restatement of every registered query (the correctness oracle).

Each SQL string restates the binding of :mod:`cohort_spark.sources.tables`
and the operator's rule directly on the driver's tables; it never reads the
Spark output. Column names equal the Spark query's.
"""

from __future__ import annotations

D = "::DOUBLE"


def _share(x: str) -> str:
    return f"CAST({x} AS DOUBLE) / CAST(n AS DOUBLE)"


def _stone(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN CAST({x} AS DOUBLE) END"


def pupil_year_sql() -> str:
    return f"""
    SELECT CAST(o.o_custkey AS VARCHAR) AS "RA", CAST(o.ano AS INTEGER) AS ano, c.c_name AS "Nome",
      c.c_mktsegment AS "Turma", nn.n_name AS "Instituição de ensino",
      CAST(o.cents AS DOUBLE) / CAST(o.n AS DOUBLE) / 5000000.0{D} AS "INDE 22",
      o.pmin / 50000.0{D} AS "Matem", o.pmax / 50000.0{D} AS "Portug",
      CASE WHEN o.n >= 2 THEN (o.pmin + o.pmax) / 100000.0{D} END AS "Inglês",
      {_stone('p1')} AS "Pedra 20", {_stone('p2')} AS "Pedra 21", {_stone('p3')} AS "Pedra 22",
      {_share('nf')} AS "IEG", {_share('no')} AS "IPS", {_share('p4')} AS "IDA", {_share('p5')} AS "IAA",
      {_share('np')} AS "IPV", {_share('p1')} AS "IAN",
      CASE WHEN nf > 0 THEN 'Sim' WHEN no > 0 THEN 'Não' END AS "Indicado",
      CASE WHEN npu > 0 THEN 'Encaminhado' WHEN np > 0 THEN '' END AS "Rec Psicologia",
      CASE WHEN np >= 2 THEN 'OK' END AS "Rec Av1",
      CASE WHEN nf >= 3 THEN ' ' END AS "Rec Av2",
      CASE WHEN no = n THEN 'Inativo' ELSE 'Ativo' END AS "Ativo/ Inativo"
    FROM (
      SELECT o_custkey, year(o_orderdate) AS ano, count(*) AS n,
        sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
        min(o_totalprice) AS pmin, max(o_totalprice) AS pmax,
        count(*) FILTER (WHERE starts_with(o_orderpriority, '1-')) AS p1,
        count(*) FILTER (WHERE starts_with(o_orderpriority, '2-')) AS p2,
        count(*) FILTER (WHERE starts_with(o_orderpriority, '3-')) AS p3,
        count(*) FILTER (WHERE starts_with(o_orderpriority, '4-')) AS p4,
        count(*) FILTER (WHERE starts_with(o_orderpriority, '5-')) AS p5,
        count(*) FILTER (WHERE o_orderstatus = 'F') AS nf,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS no,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS np,
        count(*) FILTER (WHERE o_orderstatus = 'P' AND starts_with(o_orderpriority, '1-')) AS npu
      FROM orders
      GROUP BY 1, 2) o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation nn ON c.c_nationkey = nn.n_nationkey"""


def subject_mean_sql(cols: tuple[str, ...] = ("Matem", "Portug", "Inglês")) -> str:
    s = " + ".join(f'coalesce("{c}", 0.0{D})' for c in cols)
    k = " + ".join(f'CAST("{c}" IS NOT NULL AS INTEGER)' for c in cols)
    return f"CASE WHEN ({k}) > 0 THEN ({s}) / ({k}) END"


def rule_label_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 4.0{D} THEN 'Muito Alto' WHEN {x} < 5.5{D} THEN 'Alto' "
            f"WHEN {x} < 6.5{D} THEN 'Médio' ELSE 'Regular' END")


def scored_sql() -> str:
    """pupil_year with the rule score, label and subject mean."""
    return f"""
    SELECT *, least(greatest(1.0{D} - _inde / 10.0{D}, 0.0{D}), 1.0{D}) AS _risk_score,
      {rule_label_sql('_inde')} AS _risk_label
    FROM (SELECT *, least(greatest(coalesce("INDE 22", 6.0{D}), 0.0{D}), 10.0{D}) AS _inde,
            {subject_mean_sql()} AS _media
          FROM ({pupil_year_sql()}) py0) s0"""


def with_views(body: str) -> str:
    """``body`` may refer to the CTEs ``py`` (pupil_year) and ``sc`` (scored)."""
    return f"WITH py AS ({pupil_year_sql()}),\nsc AS ({scored_sql()})\n{body}"


def pct_sql(n: str, total: str) -> str:
    return f"coalesce(CAST(round_even(CAST({n} AS DOUBLE) / NULLIF(CAST({total} AS DOUBLE), 0) * 100.0{D}, 0) AS INTEGER), 0)"


def comma_sql(x: str, places: int = 1) -> str:
    return f"coalesce(replace(printf('%.{places}f', {x}), '.', ','), '-')"



# --------------------------------------------------------------- helpers

HIGH = "_risk_label IN ('Alto', 'Muito Alto')"
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def truthy_sql(x: str) -> str:
    return f"coalesce(lower(trim(CAST({x} AS VARCHAR))) IN ('1', 'true', 'sim', 'yes', 'y', 'x', 'ok'), false)"


def blank_sql(x: str) -> str:
    return f"coalesce(lower(trim(CAST({x} AS VARCHAR))) IN ('', 'nan'), true)"


def nz(pred: str) -> str:
    return f"coalesce({pred}, false)"


def to_double_sql(x: str) -> str:
    v = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return (f"CASE WHEN regexp_matches({x}, {q(NUMERIC_TEXT)}) THEN "
            f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END) END")


def dash_sql(x: str) -> str:
    return f"CASE WHEN trim(CAST({x} AS VARCHAR)) IS NULL OR trim(CAST({x} AS VARCHAR)) = '' THEN '-' ELSE trim(CAST({x} AS VARCHAR)) END"


def mean_class_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'ok' WHEN {x} < 6.0{D} THEN 'bad' WHEN {x} < 7.0{D} THEN 'ok' ELSE 'good' END"


REC_FILLED = f'(NOT {blank_sql(chr(34) + "Rec Av1" + chr(34))} OR NOT {blank_sql(chr(34) + "Rec Av2" + chr(34))})'
COHORT_FOLLOW = (f"({nz(chr(34) + 'Ativo/ Inativo' + chr(34) + ' IS NOT NULL AND contains(lower(' + chr(34) + 'Ativo/ Inativo' + chr(34) + '), ' + q('inativ') + ')')}"
                 f" OR {nz('IEG < 0.4' + D)} OR NOT {blank_sql(chr(34) + 'Rec Psicologia' + chr(34))})")
PUPIL_FOLLOW = f"({nz('IEG < 0.4' + D)} OR {nz('IPS < 0.4' + D)} OR NOT {blank_sql(chr(34) + 'Rec Psicologia' + chr(34))})"
PARENT = f"({HIGH} AND {truthy_sql('Indicado')})"

RAW_TEXT = """
rt AS (
  SELECT event_id AS id,
    CASE event_type WHEN 'click' THEN t WHEN 'view' THEN ' ' || t || ' ' WHEN 'purchase' THEN replace(t, '.', ',')
      WHEN 'signup' THEN t || 'd' ELSE props END AS txt,
    CASE event_type WHEN 'click' THEN ' Sim ' WHEN 'view' THEN 'NÃO' WHEN 'purchase' THEN 'x'
      WHEN 'signup' THEN t ELSE 'ok' END AS flag
  FROM (SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS t
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e0) e1)"""

REQ = f"""
req AS (
  SELECT CAST(user_id AS VARCHAR) AS "RA", event_id AS pos,
    CASE WHEN event_type = 'purchase' THEN value / 50.0{D} END AS inde_in,
    CASE WHEN event_type = 'signup' THEN 'Sim' WHEN event_type = 'error' THEN ' ' END AS ind_in,
    event_type AS canal
  FROM events)"""

ALL_DOCS = f"""
ds AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 2000.0{D}) AS score FROM documents)"""

DOCS = f"""
sd AS (
  SELECT l.doc_id, CAST(l.quality AS INTEGER) AS y,
    CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0{D}) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

J1 = f"""
base AS (SELECT * FROM py WHERE ano = 1996),
jm AS (
  SELECT trim(b."RA") AS "RA", r.pos, r.canal, b."Nome",
    CASE WHEN r.inde_in IS NOT NULL AND NOT isnan(r.inde_in) THEN r.inde_in ELSE b."INDE 22" END AS inde,
    CASE WHEN r.ind_in IS NOT NULL AND trim(r.ind_in) <> '' THEN r.ind_in ELSE b."Indicado" END AS indicado
  FROM base b JOIN req r ON trim(b."RA") = trim(r."RA")),
ju AS (
  SELECT trim(r."RA") AS "RA", r.pos, r.canal, CAST(NULL AS VARCHAR) AS "Nome", r.inde_in AS inde, r.ind_in AS indicado
  FROM req r WHERE trim(r."RA") NOT IN (SELECT trim("RA") FROM base)),
j1 AS (SELECT * FROM jm UNION ALL SELECT * FROM ju)"""

LONG = f"""
st AS (
  SELECT "RA", ano, coalesce("INDE 22", 0.0{D}) AS inde, coalesce("Pedra 20", 0.0{D}) AS p0,
    coalesce("Pedra 21", 0.0{D}) AS p1, coalesce("Pedra 22", 0.0{D}) AS p2, _risk_label AS label
  FROM sc WHERE "RA" IS NOT NULL),
lg AS (
  SELECT *, lag(ano) OVER w IS NOT NULL AS has_prev,
    (inde > lag(inde) OVER w) OR (p0 > lag(p0) OVER w) OR (p1 > lag(p1) OVER w) OR (p2 > lag(p2) OVER w) AS rose
  FROM st WINDOW w AS (PARTITION BY "RA" ORDER BY ano)),
ps AS (
  SELECT "RA", count(*) FILTER (WHERE has_prev AND NOT coalesce(rose, false)) AS steps_without,
    count(*) FILTER (WHERE has_prev AND coalesce(rose, false)) AS steps_with, count(*) AS n_years,
    arg_min(inde, ano) AS first_inde, arg_max(inde, ano) AS last_inde, arg_max(label, ano) AS last_label
  FROM lg GROUP BY "RA"),
l1 AS (SELECT "RA", steps_without FROM ps WHERE steps_without >= 2),
l2 AS (SELECT "RA", first_inde, last_inde, last_label FROM ps
       WHERE last_inde > first_inde AND coalesce(last_label IN ('Regular', 'Médio'), false))"""


def list_cols_sql(prefix: str = "") -> str:
    return (f'trim({prefix}"RA") AS ra, trim({prefix}"Nome") AS nome, trim({prefix}"Turma") AS turma, '
            f'{comma_sql(prefix + "_media", 1)} AS media, {mean_class_sql(prefix + "_media")} AS media_classe, '
            f'{prefix}_risk_label AS risco')


def long_values_sql(table: str, side: str, features: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{side}' AS side, {q(name)} AS feature, CAST({expr} AS DOUBLE) AS value FROM {table}"
        for name, expr in features)


def psi_sql(ref: str, cur: str, features: list[tuple[str, str]], bins: int = 10) -> str:
    """CTEs ``lv, fin, ... drift`` restating the PSI plan with plain windows."""
    fin = f"value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'{D}"
    return f"""
lv AS ({long_values_sql(ref, 'ref', features)} UNION ALL {long_values_sql(cur, 'cur', features)}),
nn AS (SELECT * FROM lv WHERE value IS NOT NULL),
fin AS (SELECT * FROM lv WHERE {fin}),
rr AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r
       FROM fin WHERE side = 'ref'),
tg0 AS (SELECT feature, n, k, CAST(n - 1 AS DOUBLE) * (CAST(k AS DOUBLE) * {1.0 / bins!r}{D}) AS h
        FROM (SELECT feature, n, unnest(range(0, {bins + 1})) AS k
              FROM (SELECT feature, count(*) AS n FROM fin WHERE side = 'ref' GROUP BY feature) x) xk),
tg AS (SELECT feature, k, h - floor(h) AS t, CAST(floor(h) AS BIGINT) AS lo,
         least(CAST(floor(h) AS BIGINT) + 1, n - 1) AS hi FROM tg0),
qq AS (SELECT tg.feature, tg.k, tg.t, a.value AS a, b.value AS b FROM tg
       JOIN rr a ON a.feature = tg.feature AND a.r = tg.lo
       JOIN rr b ON b.feature = tg.feature AND b.r = tg.hi),
ed AS (SELECT feature, list_sort(list_distinct(list(
         CASE WHEN t >= 0.5{D} THEN b - (b - a) * (1.0{D} - t) ELSE a + (b - a) * t END))) AS edges
       FROM qq GROUP BY feature),
bn AS (SELECT f.side, f.feature,
         CASE WHEN f.value = ed.edges[len(ed.edges)] THEN len(ed.edges) - 1
              ELSE len(list_filter(ed.edges, lambda e: e <= f.value)) END AS bin, len(ed.edges) AS m
       FROM fin f JOIN ed ON f.feature = ed.feature),
cnt AS (SELECT side, feature, bin, count(*) AS c FROM bn WHERE bin >= 1 AND bin <= m - 1 GROUP BY 1, 2, 3),
grid AS (SELECT feature, m, bin, unnest(['ref', 'cur']) AS side
         FROM (SELECT feature, len(edges) AS m, unnest(range(1, greatest(len(edges) - 1, 1) + 1)) AS bin FROM ed) g),
fl AS (SELECT grid.*, coalesce(cnt.c, 0) AS c FROM grid LEFT JOIN cnt
       ON grid.side = cnt.side AND grid.feature = cnt.feature AND grid.bin = cnt.bin),
tt AS (SELECT side, feature, sum(c) AS tot FROM fl GROUP BY 1, 2),
sh AS (SELECT fl.feature, fl.bin, fl.side, fl.m,
         greatest(CAST(fl.c AS DOUBLE) / CAST(greatest(tt.tot, 1) AS DOUBLE), 1e-6{D}) AS s
       FROM fl JOIN tt ON fl.side = tt.side AND fl.feature = tt.feature),
wd AS (SELECT feature, bin, m, max(s) FILTER (WHERE side = 'ref') AS r, max(s) FILTER (WHERE side = 'cur') AS cc
       FROM sh GROUP BY 1, 2, 3),
ps0 AS (SELECT feature, m, sum((cc - r) * ln(cc / r)) AS psi_sum FROM wd GROUP BY 1, 2),
cn AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS ref_count,
         count(*) FILTER (WHERE side = 'cur') AS cur_count FROM nn GROUP BY 1),
cf AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS ref_finite,
         count(*) FILTER (WHERE side = 'cur') AS cur_finite FROM fin GROUP BY 1),
dr0 AS (SELECT cn.feature,
          CASE WHEN coalesce(cf.ref_finite, 0) = 0 THEN NULL WHEN coalesce(cf.cur_finite, 0) = 0 THEN NULL
               WHEN ps0.m < 3 THEN 0.0{D} ELSE round_even(ps0.psi_sum, 9) END AS psi,
          coalesce(cn.ref_count, 0) AS ref_count, coalesce(cn.cur_count, 0) AS cur_count
        FROM cn LEFT JOIN cf ON cn.feature = cf.feature LEFT JOIN ps0 ON cn.feature = ps0.feature),
drift AS (SELECT feature, psi,
          CASE WHEN psi IS NULL THEN 'SEM_DADOS' WHEN psi < 0.10{D} THEN 'OK' WHEN psi < 0.25{D} THEN 'ATENCAO'
               ELSE 'DRIFT' END AS status, ref_count, cur_count FROM dr0)"""


PUPIL_DRIFT_FEATURES = ["INDE 22", "IEG", "IPS", "IDA", "IPV", "IAN", "Pedra 20", "Pedra 21", "Pedra 22",
                        "Matem", "Portug", "Inglês"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
PUPIL_PSI = psi_sql("(SELECT * FROM py WHERE ano = 1996)", "(SELECT * FROM py WHERE ano = 1998)",
                    [(f, f'"{f}"') for f in PUPIL_DRIFT_FEATURES])
LINE_SIDES = ("line_ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),\n"
              "line_cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),")
LINE_PSI = LINE_SIDES + psi_sql("line_ref", "line_cur", [(f, f) for f in LINE_FEATURES])


def views(*ctes: str) -> str:
    """``WITH py, sc`` plus extra CTE blocks (each ``name AS (...)``)."""
    extra = "".join(",\n" + c.strip().rstrip(",") for c in ctes if c.strip())
    return f"WITH py AS ({pupil_year_sql()}),\nsc AS ({scored_sql()}){extra}\n"


def recommendation_sql() -> str:
    from ..functions.text import (INDE_SENTENCES, INDICATED_SENTENCE, MEAN_SENTENCES, PSYCHOLOGY_SENTENCE,
                                  RISK_SENTENCES, STONE_SENTENCES)
    nome = "coalesce(CAST(\"Nome\" AS VARCHAR), 'nan')"

    def fill(t: str, p: str | None = None) -> str:
        parts = []
        for i, chunk in enumerate(t.split("{nome}")):
            if i:
                parts.append(nome)
            if p is not None:
                sub = chunk.split("{p}")
                for j, s2 in enumerate(sub):
                    if j:
                        parts.append(q(p))
                    if s2:
                        parts.append(q(s2))
            elif chunk:
                parts.append(q(chunk))
        return " || ".join(parts)

    risk = (f"CASE WHEN _risk_label = 'Muito Alto' THEN {fill(RISK_SENTENCES['Muito Alto'])} "
            f"WHEN _risk_label = 'Alto' THEN {fill(RISK_SENTENCES['Alto'])} "
            f"WHEN _risk_label = 'Médio' THEN {fill(RISK_SENTENCES['Médio'])} "
            f"ELSE {fill(RISK_SENTENCES['other'])} END")
    inde = (f'CASE WHEN "INDE 22" < 4 THEN {q(INDE_SENTENCES[0])} WHEN "INDE 22" < 6 THEN {q(INDE_SENTENCES[1])} '
            f'WHEN "INDE 22" > 7.5 THEN {q(INDE_SENTENCES[2])} END')
    mean = (f"CASE WHEN _media < 5 THEN {q(MEAN_SENTENCES[0])} WHEN _media < 6 THEN {q(MEAN_SENTENCES[1])} "
            f"WHEN _media > 7.5 THEN {q(MEAN_SENTENCES[2])} END")
    stones = []
    for s in ("Pedra 20", "Pedra 21", "Pedra 22"):
        v = f'"{s}"'
        stones.append(f"CASE WHEN {v} <= 2 THEN {fill(STONE_SENTENCES[0], s)} WHEN {v} = 3 THEN "
                      f"{fill(STONE_SENTENCES[1], s)} WHEN {v} >= 4 THEN {fill(STONE_SENTENCES[2], s)} END")
    psych = f'CASE WHEN NOT {blank_sql(chr(34) + "Rec Psicologia" + chr(34))} THEN {q(PSYCHOLOGY_SENTENCE)} END'
    ind = f"CASE WHEN {truthy_sql('Indicado')} THEN {q(INDICATED_SENTENCE)} END"
    return f"concat_ws(' ', {risk}, {inde}, {mean}, {', '.join(stones)}, {psych}, {ind})"


def diagnosis_sql() -> str:
    pedra = "coalesce(CAST(\"Pedra 22\" AS VARCHAR), CAST(\"Pedra 21\" AS VARCHAR), CAST(\"Pedra 20\" AS VARCHAR), '-')"
    return ("'Diagnóstico para ' || trim(\"Nome\") || ': O aluno apresenta nível atual ''' || " + pedra +
            " || ''' com risco classificado como ' || coalesce(_risk_label, 'Regular') || '. ' || "
            "'Seu engajamento (IEG) está em ' || coalesce(printf('%.2f', IEG), 'nan') || "
            "' e o desempenho acadêmico (IDA) em ' || coalesce(printf('%.2f', IDA), 'nan') || '. ' || "
            "'Análise de Evolução: '")


def profile_sql() -> str:
    def st(x):
        return f"CASE WHEN {nz(x + ' >= 6.0' + D)} THEN 'Ok' ELSE 'Abaixo' END"
    return f"""trim("RA") AS ra, ano, trim("Nome") AS nome, trim("Turma") AS turma, 'risco_fallback' AS risk_type,
      round_even(_risk_score, 9) AS risk_score, _risk_label AS risco,
      CAST(round_even(coalesce(_risk_score, 0.0{D}) * 100.0{D}, 0) AS INTEGER) AS confianca,
      {comma_sql('_media', 1)} AS media, {comma_sql('"INDE 22"', 1)} AS inde_22, {comma_sql('IEG', 2)} AS ieg,
      {comma_sql('Matem', 1)} AS matem, {comma_sql('Portug', 1)} AS portug, {comma_sql('"Inglês"', 1)} AS ingles,
      {st('Matem')} AS status_matem, {st('Portug')} AS status_portug, {st('"Inglês"')} AS status_ingles,
      {comma_sql('IAA', 2)} AS iaa, {comma_sql('IPS', 2)} AS ips, {comma_sql('IDA', 2)} AS ida,
      {comma_sql('IPV', 2)} AS ipv, {comma_sql('IAN', 2)} AS ian,
      coalesce(CAST("Pedra 20" AS VARCHAR), '-') AS pedra_20, coalesce(CAST("Pedra 21" AS VARCHAR), '-') AS pedra_21,
      coalesce(CAST("Pedra 22" AS VARCHAR), '-') AS pedra_22,
      {dash_sql('"Rec Psicologia"')} AS rec_psicologia,
      CASE WHEN {truthy_sql('Indicado')} THEN 'Sim' ELSE 'Não' END AS indicado,
      {dash_sql('"Rec Av1"')} AS rec_av1, {dash_sql('"Rec Av2"')} AS rec_av2, '-' AS rec_av3, '-' AS rec_av4,
      CASE WHEN {PUPIL_FOLLOW} THEN 'Sinal para acompanhamento' ELSE 'Sem sinal crítico de acompanhamento' END
        AS acompanhamento,
      CASE WHEN {PARENT} THEN 'Aluno crítico indicado' ELSE 'Sem critério para reunião de pais' END AS reunioes_pais"""


def export_sql(year: int) -> str:
    return (f'SELECT row_number() OVER (ORDER BY "Risco", "Média" NULLS LAST, "RA") AS row_number, * FROM ('
            f'SELECT trim("RA") AS "RA", trim("Nome") AS "Aluno", trim("Turma") AS "Turma", '
            f'round_even(_media, 1) AS "Média", _risk_label AS "Risco" FROM sc WHERE ano = {year} AND {HIGH}) ex')


def ordered_list_sql(where: str) -> str:
    return (f"SELECT row_number() OVER (ORDER BY ano, _risk_score DESC, trim(\"RA\")) AS row_number, "
            f"{list_cols_sql()}, _risk_score AS risk_score, ano FROM sc WHERE {where}")


SEARCH_Q = "customer#00000012"


def search_sql(year: int, limit: int, scored: bool) -> str:
    lab = "_risk_label" if scored else "'Regular'"
    pred = " OR ".join(f"coalesce(contains(lower(CAST({c} AS VARCHAR)), {q(SEARCH_Q)}), false)"
                       for c in ('"RA"', '"Nome"', '"Turma"'))
    return (f'SELECT trim("RA") AS ra, "Nome" AS nome, "Turma" AS turma, {lab} AS risco FROM sc '
            f'WHERE ano = {year} AND ({pred}) ORDER BY trim("RA") LIMIT {limit}')


SQL: dict[str, str] = {}

# ---- sources
SQL["s1_read_snapshot"] = views() + 'SELECT "RA", ano, "Nome", "INDE 22" AS inde, "Pedra 22" AS pedra_22 FROM py WHERE ano = 1997'
SQL["s2_stack_years"] = views() + ('SELECT "RA", ano, "INDE 22" AS inde, CASE WHEN ano = (SELECT min(ano) FROM py) THEN NULL ELSE "Inglês" END '
                                   'AS ingles, "Indicado" AS indicado FROM py')
SQL["s3_export_csv"] = views() + export_sql(1997)
SQL["s4_predictions"] = views(REQ, J1) + f"""
SELECT "RA" AS ra, {rule_label_sql('_inde')} AS risk_label,
  round_even(least(greatest(1.0{D} - _inde / 10.0{D}, 0.0{D}), 1.0{D}), 9) AS risk_score,
  'risco_futuro' AS risk_type, '1.0.0' AS model_version, false AS used_model, pos
FROM (SELECT *, least(greatest(coalesce(inde, 6.0{D}), 0.0{D}), 10.0{D}) AS _inde FROM j1) x"""
SQL["t1_stream_scoring"] = SQL["s4_predictions"]  # the same rule on a stream of the same requests
SQL["s5_requests_json"] = views(REQ) + 'SELECT "RA", pos, inde_in AS inde, ind_in AS indicado, canal FROM req'
SQL["s8_ledger"] = views() + f"""
SELECT 'S' || CAST(ano AS VARCHAR) AS sheet, "RA" AS ra, "Nome" AS nome, "Turma" AS turma,
  strftime(make_date(ano, 12, 31), '%Y-%m-%d') AS data,
  CASE WHEN {nz('Matem < 6.0' + D)} THEN 'Matemática' ELSE 'Português' END AS disciplina,
  'INDE ' || {comma_sql('"INDE 22"', 1)} AS observacao
FROM sc WHERE {PARENT}"""

# ---- normalisation
SQL["n1_standardize_columns"] = """
SELECT CAST(c_custkey AS VARCHAR) AS "RA", c_name AS "Nome", n_name AS "Instituição de ensino", c_acctbal AS "Matem",
  c_mktsegment AS "Fase ideal", c_nationkey AS "Idade 22"
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
SQL["n2_coerce_numeric"] = f"WITH {RAW_TEXT.strip()}\nSELECT id, txt, {to_double_sql('txt')} AS num FROM rt"
SQL["n3_clean_numeric"] = (f"WITH {RAW_TEXT.strip()}\nSELECT id, num FROM (SELECT id, {to_double_sql('txt')} AS num FROM rt) x "
                           f"WHERE num IS NOT NULL AND NOT isnan(num) AND abs(num) < 'inf'{D}")
SQL["n4_binary_target"] = f"""WITH {RAW_TEXT.strip()}
SELECT id, flag, CASE WHEN lower(trim(flag)) IN ('1', 'true', 'sim', 's', 'yes', 'y', 'x') THEN 1
  WHEN lower(trim(flag)) IN ('0', 'false', 'nao', 'não', 'n', 'no', '') THEN 0
  ELSE CAST(coalesce({to_double_sql('flag')} > 0, false) AS INTEGER) END AS target FROM rt"""
SQL["n5_truthy"] = f"WITH {RAW_TEXT.strip()}\nSELECT id, flag, {truthy_sql('flag')} AS truthy FROM rt"


def _cat(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR CAST({x} AS VARCHAR) = 'nan' THEN '' ELSE CAST({x} AS VARCHAR) END"


SQL["n6_categorical_clean"] = views() + (f'SELECT "RA", ano, {_cat("Indicado")} AS indicado, '
                                         f'{_cat(chr(34) + "Rec Psicologia" + chr(34))} AS rec_psicologia, '
                                         f'{_cat(chr(34) + "Pedra 20" + chr(34))} AS pedra_20 FROM py')
_CAT = ["Indicado", "Instituição de ensino", "Turma"]
_NUM = ["IAA", "IAN", "IDA", "IEG", "INDE 22", "IPS", "IPV", "Inglês", "Matem", "Pedra 20", "Pedra 21", "Pedra 22",
        "Portug"]
SQL["n7_feature_choice"] = views() + ('SELECT "RA", ano, ' + ", ".join(f'{_cat(chr(34) + c + chr(34))} AS "{c}"' for c in _CAT)
                                      + ", " + ", ".join(f'"{c}"' for c in _NUM) + " FROM py")
SQL["n8_align_schema"] = views(REQ) + (
    'SELECT "RA", pos, ' + _cat("ind_in") + ' AS "Indicado", CAST(NULL AS VARCHAR) AS "Instituição de ensino", '
    'CAST(NULL AS VARCHAR) AS "Turma", '
    + ", ".join(("inde_in" if c == "INDE 22" else "CAST(NULL AS DOUBLE)") + f' AS "{c}"' for c in _NUM) + " FROM req")
SQL["n9_next_year"] = """
SELECT sheet, CASE WHEN length(regexp_replace(sheet, '[^0-9]', '', 'g')) > 0
    THEN regexp_replace(sheet, '[^0-9]', '', 'g') ELSE 'base' END AS base_year,
  CASE WHEN length(regexp_replace(sheet, '[^0-9]', '', 'g')) = 4
  THEN CAST(CAST(regexp_replace(sheet, '[^0-9]', '', 'g') AS INTEGER) + 1 AS VARCHAR) ELSE 'próximo ano' END AS next_year
FROM (SELECT 'S' || CAST(year(o_orderdate) AS VARCHAR) AS sheet FROM orders
      UNION SELECT n_name FROM nation) s"""
SQL["n10_first_per_key"] = views(REQ) + """
SELECT "RA", pos, canal FROM (SELECT *, row_number() OVER (PARTITION BY "RA" ORDER BY pos) AS rn FROM req) x WHERE rn = 1"""

# ---- scalars
SQL["c1_subject_mean"] = views() + 'SELECT "RA", ano, _media AS media FROM sc'
SQL["c2_mean_class"] = views() + f'SELECT "RA", ano, {mean_class_sql("_media")} AS media_classe FROM sc'
SQL["c3_rule_score"] = views() + 'SELECT "RA", ano, round_even(_risk_score, 9) AS risk_score FROM sc'
SQL["c4_rule_label"] = views() + 'SELECT "RA", ano, _risk_label AS risk_label FROM sc'
_CLIP = f"least(greatest(coalesce(score, 0.0{D}), 0.0{D}), 1.0{D})"
SQL["c5_proba_label"] = f"""WITH {ALL_DOCS.strip()}
SELECT doc_id, CASE WHEN {_CLIP} >= 0.85{D} THEN 'Muito Alto' WHEN {_CLIP} >= 0.70{D} THEN 'Alto'
  WHEN {_CLIP} >= 0.50{D} THEN 'Médio' ELSE 'Regular' END AS risk_label, round_even({_CLIP}, 9) AS risk_score FROM ds"""
SQL["c6_future_label"] = f"""WITH {ALL_DOCS.strip()}
SELECT doc_id, CASE WHEN score >= 0.70{D} THEN 'Alta Defasagem' WHEN score >= 0.40{D} THEN 'Risco Moderado'
  ELSE 'Baixo Risco' END AS future_label FROM ds"""
SQL["c7_minmax_scale"] = """
WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS raw FROM documents),
mm AS (SELECT min(raw) AS mn, max(raw) AS mx FROM d)
SELECT doc_id, round_even(CASE WHEN (SELECT mx FROM mm) > (SELECT mn FROM mm)
  THEN (raw - (SELECT mn FROM mm)) / ((SELECT mx FROM mm) - (SELECT mn FROM mm)) ELSE 0.0::DOUBLE END, 12) AS scaled
FROM d"""
SQL["c8_same_year_target"] = views() + (
    f'SELECT "RA", ano, CAST(({nz(chr(34) + "INDE 22" + chr(34) + " < 4.0" + D)} OR {nz("IPS < 0.4" + D)} '
    f'OR {nz(chr(34) + "Pedra 22" + chr(34) + " <= 1.0" + D)}) AS INTEGER) AS target FROM py')
SQL["c9_decimal_display"] = views() + (
    f'SELECT "RA", ano, {comma_sql(chr(34) + "INDE 22" + chr(34), 1)} AS inde_txt, {comma_sql("_media", 1)} AS media_txt, '
    f'{comma_sql("IEG", 2)} AS ieg_txt, {comma_sql(chr(34) + "Inglês" + chr(34), 1)} AS ingles_txt FROM sc')
SQL["c10_latest_stone"] = views() + (
    'SELECT trim("RA") AS ra, ano, coalesce(CAST("Pedra 22" AS VARCHAR), CAST("Pedra 21" AS VARCHAR), '
    'CAST("Pedra 20" AS VARCHAR), \'-\') AS ultima_pedra FROM sc')
SQL["c11_recovery_filled"] = views() + f'SELECT trim("RA") AS ra, ano, {REC_FILLED} AS recuperacao FROM sc'
SQL["c12_cohort_follow_up"] = views() + f'SELECT trim("RA") AS ra, ano, {COHORT_FOLLOW} AS acomp_coorte FROM sc'
SQL["c13_pupil_follow_up"] = views() + f'SELECT trim("RA") AS ra, ano, {PUPIL_FOLLOW} AS acomp_aluno FROM sc'
SQL["c14_parent_meeting"] = views() + f'SELECT trim("RA") AS ra, ano, {PARENT} AS reuniao_pais FROM sc'
SQL["c15_recommendation"] = views() + f'SELECT trim("RA") AS ra, ano, {recommendation_sql()} AS recomendacao FROM sc'
SQL["c16_diagnosis"] = views() + f'SELECT trim("RA") AS ra, ano, {diagnosis_sql()} AS diagnostico FROM sc'
SQL["c17_pupil_profile"] = views() + f"SELECT {profile_sql()} FROM sc"
SQL["c18_subject_status"] = views() + ("SELECT ra, ano, status_matem, status_portug, status_ingles FROM "
                                       f"(SELECT {profile_sql()} FROM sc) p")
SQL["c19_confidence"] = views() + f"SELECT ra, ano, confianca FROM (SELECT {profile_sql()} FROM sc) p"
SQL["c20_psi_status"] = views(PUPIL_PSI) + "SELECT feature, status FROM drift"

# ---- filters
SQL["p1_filter_school"] = views() + 'SELECT "RA", ano, _risk_label FROM sc WHERE trim("Instituição de ensino") = \'NATION_7\''
SQL["p2_search"] = views() + (
    'SELECT "RA", ano, "Nome" FROM sc WHERE ' + " OR ".join(
        f"coalesce(contains(lower(CAST({c} AS VARCHAR)), {q(SEARCH_Q)}), false)"
        for c in ('"Nome"', '"Turma"', '"Matem"', '"Portug"', '"Inglês"')))
SQL["p3_filter_fallback"] = views() + """
SELECT "RA", ano, 'unknown' AS "case" FROM sc
UNION ALL
SELECT "RA", ano, 'known' AS "case" FROM sc
WHERE coalesce(trim("Instituição de ensino") = 'NATION_7', false)
   OR (SELECT count(*) FROM sc WHERE coalesce(trim("Instituição de ensino") = 'NATION_7', false)) = 0"""
SQL["p4_search_pupils"] = views() + search_sql(1997, 20, False)
SQL["p5_search_scored"] = views() + search_sql(1997, 10, True)
SQL["p6_lookup"] = views() + ('SELECT "RA", ano, round_even(_risk_score, 9) AS risk_score, _risk_label AS risk_label '
                              "FROM sc WHERE trim(\"RA\") = '123'")
SQL["p7_high_risk"] = views() + f'SELECT "RA", ano, _risk_label FROM sc WHERE {HIGH}'
SQL["p8_follow_up_list"] = views() + ordered_list_sql("_risk_label = 'Muito Alto'")
SQL["p9_parent_meeting_list"] = views() + ordered_list_sql(PARENT)
SQL["p10_temporal_split"] = views() + ("SELECT \"RA\", ano, CASE WHEN ano < 2001 THEN 'train' ELSE 'test' END AS split "
                                       "FROM py WHERE ano <= 2001")

# ---- joins
SQL["j1_enrich_requests"] = views(REQ, J1) + 'SELECT "RA", pos, inde, indicado, canal, "Nome" FROM j1'
SQL["j1_unknown_requests"] = views(REQ) + """
SELECT trim("RA") AS "RA", pos FROM req WHERE trim("RA") NOT IN (SELECT trim("RA") FROM py WHERE ano = 1996)"""
SQL["j2_batch_lookup"] = views(REQ) + """
SELECT trim(r."RA") AS ra, r.pos, round_even(s._risk_score, 9) AS risk_score, s._risk_label AS risk_label
FROM req r JOIN (SELECT * FROM sc WHERE ano = 1996) s ON trim(r."RA") = trim(s."RA")"""
SQL["j3_semi_join"] = views(REQ) + """
SELECT "RA", "Nome" FROM py WHERE ano = 1996 AND trim("RA") IN (SELECT trim("RA") FROM req)"""

# ---- aggregations
_BY = 'ano, "Instituição de ensino" AS escola'
SQL["a1_risk_indicators"] = views() + f"""
SELECT {_BY},
  count(*) FILTER (WHERE {HIGH}) AS n_high,
  {pct_sql("count(*) FILTER (WHERE " + HIGH + ")", "count(*)")} AS pct_high,
  count(*) FILTER (WHERE _risk_label = 'Médio') AS n_medium,
  {pct_sql("count(*) FILTER (WHERE _risk_label = 'Médio')", "count(*)")} AS pct_medium,
  count(*) FILTER (WHERE _risk_label = 'Regular') AS n_regular,
  {pct_sql("count(*) FILTER (WHERE _risk_label = 'Regular')", "count(*)")} AS pct_regular,
  count(*) AS total
FROM sc GROUP BY 1, 2"""
SQL["a2_overall_mean"] = views() + f"""
SELECT ano, escola, round_even(round_even(m, 12), 6) AS media_geral, {comma_sql('m', 1)} AS media_geral_display FROM (
  SELECT {_BY}, coalesce(avg("INDE 22"), avg(_media)) AS m FROM sc GROUP BY 1, 2) x"""
SQL["a3_below_pass"] = views() + f"""
SELECT {_BY}, count(*) FILTER (WHERE Matem < 6.0{D}) AS matematica, count(*) FILTER (WHERE Portug < 6.0{D}) AS portugues,
  count(*) FILTER (WHERE "Inglês" < 6.0{D}) AS ingles FROM sc GROUP BY 1, 2"""
SQL["a4_stone_trend"] = views() + " UNION ALL ".join(
    f"SELECT ano, '{s}' AS label, coalesce(round_even(avg(\"{s}\"), 2), 0.0{D}) AS media, "
    f"count(*) FILTER (WHERE \"{s}\" <= 2.0{D}) AS risco FROM py GROUP BY ano"
    for s in ("Pedra 20", "Pedra 21", "Pedra 22"))
SQL["a5_action_counts"] = views(LONG) + f"""
SELECT ano, count(*) FILTER (WHERE {HIGH} AND NOT {REC_FILLED}) AS plano_reforco,
  count(*) FILTER (WHERE {COHORT_FOLLOW}) AS acompanhamento, count(*) FILTER (WHERE {PARENT}) AS reuniao_pais,
  (SELECT count(*) FROM l1) AS sem_progresso, (SELECT count(*) FROM l2) AS proxima_fase
FROM sc GROUP BY ano"""
SQL["a6_alert_count"] = views() + (f"SELECT {_BY}, count(*) FILTER (WHERE {HIGH}) + "
                                   f"count(*) FILTER (WHERE {truthy_sql('Indicado')}) AS alertas, "
                                   f"count(*) FILTER (WHERE _risk_label = 'Muito Alto') AS alertas_acompanhamento, "
                                   f"count(*) FILTER (WHERE {HIGH}) AS alertas_reuniao FROM sc GROUP BY 1, 2")
SQL["a7_schools"] = views() + """
SELECT DISTINCT trim("Instituição de ensino") AS escola FROM py
WHERE trim("Instituição de ensino") IS NOT NULL AND trim("Instituição de ensino") <> ''"""
_Y = f'CAST(({nz(chr(34) + "INDE 22" + chr(34) + " < 4.0" + D)} OR {nz("IPS < 0.4" + D)} OR {nz(chr(34) + "Pedra 22" + chr(34) + " <= 1.0" + D)}) AS INTEGER)'
SQL["a8_class_weights"] = views() + f"""
SELECT "RA", ano, y, round_even(CASE WHEN pos = 0 OR n - pos = 0 THEN 1.0{D}
    WHEN y = 1 THEN CAST(n AS DOUBLE) / (2.0{D} * CAST(pos AS DOUBLE))
    ELSE CAST(n AS DOUBLE) / (2.0{D} * CAST(n - pos AS DOUBLE)) END, 12) AS w
FROM (SELECT "RA", ano, {_Y} AS y, (SELECT count(*) FROM py WHERE ano < 2001) AS n,
        (SELECT count(*) FILTER (WHERE {_Y} = 1) FROM py WHERE ano < 2001) AS pos FROM py WHERE ano < 2001) t"""
SQL["a9_dataset_sizes"] = views() + ("SELECT count(*) FILTER (WHERE ano < 2001) AS n_train, "
                                     "count(*) FILTER (WHERE ano = 2001) AS n_test FROM py")
_HIST_BIN = " + ".join(f"CASE WHEN f.value >= {k}.0{D} * h.step + h.lo THEN 1 ELSE 0 END" for k in range(1, 10))
SQL["a10_histogram"] = "WITH " + LINE_SIDES + f"""
lv AS ({long_values_sql('line_ref', 'ref', [(f, f) for f in LINE_FEATURES])} UNION ALL
       {long_values_sql('line_cur', 'cur', [(f, f) for f in LINE_FEATURES])}),
fin AS (SELECT * FROM lv WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'{D}),
hs AS (SELECT side, feature, CASE WHEN mx > mn THEN mn ELSE mn - 0.5{D} END AS lo,
         CASE WHEN mx > mn THEN mx ELSE mx + 0.5{D} END AS hi
       FROM (SELECT side, feature, min(value) AS mn, max(value) AS mx FROM fin GROUP BY 1, 2) x),
h AS (SELECT *, (hi - lo) / 10.0{D} AS step FROM hs),
hb AS (SELECT f.side, f.feature, {_HIST_BIN} AS bin FROM fin f JOIN h ON f.side = h.side AND f.feature = h.feature),
hc AS (SELECT side, feature, bin, count(*) AS c FROM hb GROUP BY 1, 2, 3)
SELECT g.side, g.feature, g.bin, round_even(CAST(g.bin AS DOUBLE) * g.step + g.lo, 9) AS left_edge,
  coalesce(hc.c, 0) AS count
FROM (SELECT *, unnest(range(0, 10)) AS bin FROM h) g
LEFT JOIN hc ON hc.side = g.side AND hc.feature = g.feature AND hc.bin = g.bin"""
SQL["a11_psi"] = "WITH " + LINE_PSI.strip() + "\nSELECT feature, psi FROM drift"
SQL["a12_drift"] = "WITH " + LINE_PSI.strip() + "\nSELECT * FROM drift"
SQL["a13_status_summary"] = views(PUPIL_PSI) + " UNION ALL ".join(
    f"SELECT '{s}' AS status, count(*) FILTER (WHERE status = '{s}') AS n FROM drift"
    for s in ("OK", "ATENCAO", "DRIFT", "SEM_DADOS"))
_CM = """(SELECT count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y <> 1) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND y <> 1) AS tn FROM sd)"""


def _div0(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0{D})"


_PRF = (f"round_even({_div0('tp', 'tp + fp')}, 12) AS precision, round_even({_div0('tp', 'tp + fn')}, 12) AS recall, "
        f"round_even({_div0('2 * tp', '2 * tp + fp + fn')}, 12) AS f1")
SQL["a14_threshold_metrics"] = f"WITH {DOCS.strip()}\nSELECT tp, fp, fn, tn, {_PRF} FROM {_CM} c"
_RANK = f"""
th AS (SELECT score AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sd GROUP BY score),
cu AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cp,
         coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM th),
rk AS (SELECT sum(pos) AS "P", sum(neg) AS "N",
         sum(CAST(neg AS DOUBLE) * (CAST(cp AS DOUBLE) + CAST(pos AS DOUBLE) / 2.0{D})) AS u,
         sum(CAST(pos AS DOUBLE) * (CAST(cp + pos AS DOUBLE) / CAST(cp + cn + pos + neg AS DOUBLE))) AS ap FROM cu),
rm AS (SELECT CASE WHEN "P" > 0 AND "N" > 0 THEN round_even(u / (CAST("P" AS DOUBLE) * CAST("N" AS DOUBLE)), 12) END AS roc_auc,
         CASE WHEN "P" > 0 AND "N" > 0 THEN round_even(ap / CAST("P" AS DOUBLE), 12) END AS pr_auc,
         "P" AS n_pos, "N" AS n_neg FROM rk)"""
SQL["a15_roc_auc"] = f"WITH {DOCS.strip()},{_RANK}\nSELECT roc_auc FROM rm"
SQL["a16_avg_precision"] = f"WITH {DOCS.strip()},{_RANK}\nSELECT pr_auc FROM rm"
SQL["a17_evaluation"] = f"""WITH {DOCS.strip()},{_RANK},
pm AS (SELECT {_PRF} FROM {_CM} c0)
SELECT n_pos, n_neg, roc_auc, pr_auc,
  CASE WHEN n_pos > 0 AND n_neg > 0 THEN (SELECT f1 FROM pm) END AS f1,
  CASE WHEN n_pos > 0 AND n_neg > 0 THEN (SELECT precision FROM pm) END AS precision,
  CASE WHEN n_pos > 0 AND n_neg > 0 THEN (SELECT recall FROM pm) END AS recall
FROM rm"""

# ---- longitudinal
SQL["l1_no_progress"] = views(LONG) + "SELECT * FROM l1"
SQL["l2_next_phase"] = views(LONG) + ('SELECT "RA", round_even(first_inde, 9) AS first_inde, '
                                      'round_even(last_inde, 9) AS last_inde, last_label FROM l2')
SQL["l3_evolution"] = views(LONG) + """
SELECT k."RA", coalesce(ps.steps_with = 0, false) AS sem_progresso,
  coalesce(ps.last_inde > ps.first_inde AND coalesce(ps.last_label IN ('Regular', 'Médio'), false), false) AS proxima_fase,
  CASE WHEN ps."RA" IS NULL THEN 'Histórico insuficiente.' ELSE '' END AS mensagem
FROM (SELECT DISTINCT trim(CAST(user_id AS VARCHAR)) AS "RA" FROM events) k LEFT JOIN ps ON k."RA" = ps."RA\""""
SQL["l4_top_high_risk"] = views() + f"""
SELECT * FROM (SELECT ano, row_number() OVER (PARTITION BY ano ORDER BY _risk_score DESC, trim("RA")) AS row_number,
  {list_cols_sql()}, round_even(_risk_score, 9) AS risk_score FROM sc WHERE {HIGH}) x WHERE row_number <= 15"""

# ---- orders
SQL["o1_full_list"] = views() + f"""
SELECT row_number() OVER (ORDER BY _risk_score DESC, trim("RA")) AS row_number, {list_cols_sql()},
  round_even(_risk_score, 9) AS risk_score FROM sc WHERE ano = 1997"""
SQL["o2_export_order"] = views() + export_sql(1997)
SQL["o3_drift_order"] = views(PUPIL_PSI) + """
SELECT row_number() OVER (ORDER BY psi DESC NULLS LAST, feature) AS row_number, feature, psi, status, ref_count, cur_count
FROM drift"""

# ---- model
SQL["m5_stratified_split"] = views().rstrip() + f"""
, lab AS (SELECT "RA", ano, {_Y} AS y,
    ((CAST("RA" AS BIGINT) % 1000003) * 999983 + ano) % 1000003 AS h FROM py),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, CAST("RA" AS BIGINT), ano) - 1 AS r FROM lab),
per AS (SELECT y, count(*) AS nc FROM lab GROUP BY y),
tot AS (SELECT sum(nc) AS n, CAST(ceil(CAST(sum(nc) AS DOUBLE) * 0.2{D}) AS BIGINT) AS n_test FROM per),
p1 AS (SELECT y, CAST((SELECT n_test FROM tot) AS DOUBLE) * CAST(nc AS DOUBLE)
         / CAST((SELECT n FROM tot) AS DOUBLE) AS cont, (SELECT n_test FROM tot) AS n_test FROM per),
p2 AS (SELECT y, floor(cont) AS fl, cont - floor(cont) AS fr, n_test FROM p1),
al AS (SELECT y, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, y)
                             <= n_test - (SELECT sum(fl) FROM p2) THEN 1 ELSE 0 END AS alloc FROM p2)
SELECT rk."RA", rk.ano, rk.y, rk.r < al.alloc AS is_test FROM rk JOIN al ON rk.y = al.y"""
SQL["m7_scorer_choice"] = views() + f"""
SELECT trim("RA") AS ra, _risk_label AS risk_label, round_even(_risk_score, 9) AS risk_score,
  'risco_futuro' AS risk_type, CAST(NULL AS VARCHAR) AS model_version, false AS used_model
FROM sc WHERE ano = 1996"""
SQL["m7_raw_predictions"] = views() + f"""
SELECT "RA", ano, round_even(s, 9) AS risk_score, CASE WHEN s >= 0.85{D} THEN 'Muito Alto' WHEN s >= 0.70{D} THEN 'Alto'
  WHEN s >= 0.50{D} THEN 'Médio' ELSE 'Regular' END AS risk_label,
  CASE WHEN s >= 0.70{D} THEN 'Alta Defasagem' WHEN s >= 0.40{D} THEN 'Risco Moderado' ELSE 'Baixo Risco' END AS future_label,
  round_even(_media, 9) AS media
FROM (SELECT "RA", ano, _media, CASE WHEN mx > mn THEN (-"INDE 22" - mn) / (mx - mn) ELSE 0.0{D} END AS s
      FROM sc, (SELECT min(-"INDE 22") AS mn, max(-"INDE 22") AS mx FROM py) mm) x"""

_BLANK_CAT = "CASE WHEN {x} IS NULL OR CAST({x} AS VARCHAR) IN ('nan', '') THEN '<blank>' ELSE CAST({x} AS VARCHAR) END"
SQL["m1_category_modes"] = views() + "SELECT feature, mode, n_categories FROM (SELECT feature, value AS mode, " + \
    "row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rk, count(*) OVER (PARTITION BY feature) " + \
    "AS n_categories FROM (SELECT feature, value, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT {q(c)} AS feature, " + _BLANK_CAT.format(x=f'"{c}"') + " AS value FROM py WHERE ano < 2001"
        for c in _CAT) + ") l GROUP BY 1, 2) c) r WHERE rk = 1"
SQL["m2_numeric_medians"] = views() + " UNION ALL ".join(
    f"SELECT {q(c)} AS feature, round_even(quantile_cont(\"{c}\", 0.5), 9) AS median FROM py "
    f"WHERE ano < 2001 AND \"{c}\" IS NOT NULL AND NOT isnan(\"{c}\") AND abs(\"{c}\") < 'inf'{D} "
    f"HAVING count(*) > 0" for c in _NUM)
SQL["o4_union_by_name"] = views() + f"""
SELECT "RA", ano, round_even(least(greatest(1.0{D} - _inde2 / 10.0{D}, 0.0{D}), 1.0{D}), 9) AS risk_score,
  {rule_label_sql('_inde2')} AS risk_label, CASE WHEN ano = (SELECT min(ano) FROM py) THEN NULL ELSE "INDE 22" END AS inde
FROM (SELECT *, CASE WHEN ano = (SELECT min(ano) FROM py) THEN least(greatest(coalesce(_media, 6.0{D}), 0.0{D}), 10.0{D})
                ELSE _inde END AS _inde2 FROM sc) x"""
SQL["c8_next_year_target"] = views() + f"""
SELECT a."RA", a.ano, b.target_next FROM py a
LEFT JOIN (SELECT trim("RA") AS k, ano - 1 AS y, {_Y} AS target_next FROM py) b
  ON trim(a."RA") = b.k AND a.ano = b.y"""

# ---- streams: the windows of the whole table, counted at once
SQL["t2_stream_drift"] = "WITH " + LINE_PSI.strip() + f""",
wl AS ({" UNION ALL ".join(f"SELECT l_shipdate, {q(f)} AS feature, CAST({f} AS DOUBLE) AS value FROM lineitem" for f in LINE_FEATURES)}),
wb AS (SELECT time_bucket(INTERVAL 90 DAYS, wl.l_shipdate, TIMESTAMP '1970-01-01') AS ws, wl.feature, len(ed.edges) AS m,
         CASE WHEN wl.value = ed.edges[len(ed.edges)] THEN len(ed.edges) - 1
              ELSE len(list_filter(ed.edges, lambda e: e <= wl.value)) END AS bin
       FROM wl JOIN ed ON wl.feature = ed.feature
       WHERE l_shipdate IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'{D}),
wc AS (SELECT ws, feature, m, count(*) AS cur_count, count(*) FILTER (WHERE bin BETWEEN 1 AND m - 1) AS tot FROM wb GROUP BY 1, 2, 3),
wn AS (SELECT ws, feature, bin, count(*) AS c FROM wb GROUP BY 1, 2, 3),
wx AS (SELECT wc.ws, wc.feature, wc.m, wc.cur_count, sh.s AS r,
         greatest(CAST(coalesce(wn.c, 0) AS DOUBLE) / CAST(greatest(wc.tot, 1) AS DOUBLE), 1e-6{D}) AS x
       FROM wc JOIN sh ON sh.feature = wc.feature AND sh.side = 'ref'
       LEFT JOIN wn ON wn.ws = wc.ws AND wn.feature = wc.feature AND wn.bin = sh.bin),
wp AS (SELECT ws, feature, cur_count, CASE WHEN m < 3 THEN 0.0{D} ELSE round_even(sum((x - r) * ln(x / r)), 9) END AS psi
       FROM wx GROUP BY ws, feature, cur_count, m)
SELECT ws AS window_start, ws + INTERVAL 90 DAYS AS window_end, feature, psi,
  CASE WHEN psi < 0.10{D} THEN 'OK' WHEN psi < 0.25{D} THEN 'ATENCAO' ELSE 'DRIFT' END AS status, cur_count,
  ws + INTERVAL 90 DAYS <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAYS AS closed
FROM wp"""

# ---- model tables
def _safe(c: str) -> str:
    return "f_" + "".join(ch if ch.isalnum() and ch.isascii() else "_" for ch in c)


def _finite(x: str) -> str:
    return f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 'inf'{D}"


def _filled_sql(source: str) -> str:
    """``source`` with cleaned categories and median-filled numbers (medians of its own rows)."""
    cats = ", ".join(_BLANK_CAT.format(x=f's."{c}"') + f" AS {_safe(c)}" for c in _CAT)
    nums = ", ".join(f'coalesce(s."{c}", m.{_safe(c)}) AS {_safe(c)}' for c in _NUM)
    meds = ", ".join(f'quantile_cont("{c}", 0.5) FILTER (WHERE {_finite(chr(34) + c + chr(34))}) AS {_safe(c)}' for c in _NUM)
    return f"SELECT s.*, {cats}, {nums} FROM {source} s, (SELECT {meds} FROM {source}) m"


_SCALED = "(coalesce(s.\"{c}\", st.m_{f}) - st.a_{f}) / CASE WHEN st.d_{f} > 1e-12 * greatest(1.0{d}, abs(st.a_{f})) THEN st.d_{f} ELSE 1.0{d} END"
SQL["m3_feature_matrix"] = views().rstrip() + f""",
tr AS (SELECT * FROM py WHERE ano < 2001),
fl AS ({_filled_sql("tr")}),
kc AS ({" UNION ALL ".join(f"SELECT DISTINCT {q(_safe(c))} AS feature, {_safe(c)} AS value FROM fl" for c in _CAT)}),
st AS (SELECT {", ".join(f'(SELECT quantile_cont("{c}", 0.5) FROM tr WHERE {_finite(chr(34) + c + chr(34))}) AS m_{_safe(c)}, avg({_safe(c)}) AS a_{_safe(c)}, stddev_pop({_safe(c)}) AS d_{_safe(c)}' for c in _NUM)} FROM fl)
SELECT s."RA", s.ano, CAST((SELECT count(*) FROM kc) + {len(_NUM)} AS INTEGER) AS n_features,
  CAST({" + ".join([f"CAST(({q(_safe(c))}, " + _BLANK_CAT.format(x=f's."{c}"') + ") IN (SELECT (feature, value) FROM kc) AS INTEGER)" for c in _CAT]
                   + [f"CAST(abs({_SCALED.format(c=c, f=_safe(c), d=D)}) >= 5e-10 AS INTEGER)" for c in _NUM])} AS INTEGER) AS nnz
FROM py s, st"""

#: Rows of the model's training years with the next year's target.
_NEXT = f"""
nx AS (SELECT a.*, b.y FROM py a JOIN (SELECT trim("RA") AS k, ano - 1 AS yr, max({_Y}) AS y FROM py GROUP BY 1, 2) b ON trim(a."RA") = b.k AND a.ano = b.yr)"""
SQL["m4_root_candidates"] = views().rstrip() + "," + _NEXT + f""",
tr AS (SELECT * FROM nx WHERE ano < 2000),
fl AS ({_filled_sql("tr")}),
nn AS (SELECT count(*) AS n, sum(y) AS pos FROM tr),
ww AS (SELECT n, pos, CAST(n AS DOUBLE) / (2.0{D} * pos) AS w1, CAST(n AS DOUBLE) / (2.0{D} * (n - pos)) AS w0 FROM nn),
sc2 AS (SELECT *, pow(2.0{D}, 24 - ceil(log2(greatest(1.0{D}, w1, w0)))) AS scale FROM ww),
gi AS (SELECT *, -round_even(w1 * 0.5{D} * scale, 0) AS g1, round_even(w0 * 0.5{D} * scale, 0) AS g0,
         round_even(w1 * 0.25{D} * scale, 0) AS h1, round_even(w0 * 0.25{D} * scale, 0) AS h0 FROM sc2),
cc AS ({" UNION ALL ".join(f"SELECT {q(_safe(c))} AS feature, {_safe(c)} AS category, CAST(NULL AS DOUBLE) AS cut, count(*) AS n_left, sum(y) AS pos_left FROM fl GROUP BY ALL" for c in _CAT)}),
nv AS ({" UNION ALL ".join(f"SELECT {q(_safe(c))} AS feature, {_safe(c)} AS v, count(*) AS n, sum(y) AS pos FROM fl WHERE {_safe(c)} IS NOT NULL GROUP BY ALL" for c in _NUM)}),
nc AS (SELECT feature, v, n, sum(n) OVER w AS n_left, sum(pos) OVER w AS pos_left, sum(n) OVER (PARTITION BY feature) AS total,
         count(*) OVER (PARTITION BY feature) AS vals, max(v) OVER (PARTITION BY feature) AS last FROM nv WINDOW w AS (PARTITION BY feature ORDER BY v)),
ca AS (SELECT * FROM cc UNION ALL
       SELECT feature, NULL, v, n_left, pos_left FROM nc WHERE v < last AND (vals <= 255 OR (255 * (n_left - n)) // total < (255 * n_left) // total)),
gl AS (SELECT feature, category, cut, n_left, n, (pos_left * g1 + (n_left - pos_left) * g0) / scale AS gl, (pos_left * h1 + (n_left - pos_left) * h0) / scale AS hl,
         (pos * g1 + (n - pos) * g0) / scale AS gs, (pos * h1 + (n - pos) * h0) / scale AS hs FROM ca, gi)
SELECT feature, category, round_even(cut, 9) AS cut, CAST(n_left AS BIGINT) AS n_left, round_even(gl, 6) AS g_left, round_even(hl, 6) AS h_left,
  CASE WHEN n_left >= 20 AND n - n_left >= 20 AND least(hl, hs - hl) >= 0.001
       THEN round_even(gl * gl / (hl + 0.1{D}) + (gs - gl) * (gs - gl) / (hs - hl + 0.1{D}) - gs * gs / (hs + 0.1{D}), 6) END AS gain
FROM gl"""
SQL["m9_model_info"] = "SELECT 'histogram_boosting_classifier' AS model_name, '1.0.0' AS model_version, position, feature FROM (VALUES " + \
    ", ".join(f"({i}, {q(c)})" for i, c in enumerate(_CAT + _NUM)) + ") v(position, feature)"
SQL["s6_metadata"] = views().rstrip() + "," + _NEXT + f"""
SELECT 'histogram_boosting_classifier' AS model_name, '1.0.0' AS model_version, {len(_CAT) + len(_NUM)} AS n_features,
  0.85{D} AS muito_alto_gte, 0.70{D} AS alto_gte, 0.50{D} AS medio_gte,
  count(*) FILTER (WHERE ano < 2000) AS n_train, count(*) FILTER (WHERE ano = 2000) AS n_test,
  count(*) FILTER (WHERE ano = 2000 AND y = 1) AS n_pos, count(*) FILTER (WHERE ano = 2000 AND y = 0) AS n_neg FROM nx"""
SQL["s7_model_roundtrip"] = views() + f'SELECT "RA", ano, 0.0{D} AS difference FROM py WHERE ano = 2001'

# ---- cohort cube and dashboard
_CUBE = f"""n_high, {pct_sql("n_high", "total")} AS pct_high, n_medium, {pct_sql("n_medium", "total")} AS pct_medium,
  n_regular, {pct_sql("n_regular", "total")} AS pct_regular, total, round_even(round_even(m, 12), 6) AS media_geral,
  {comma_sql("m", 1)} AS media_geral_display, matematica, portugues, ingles, m0, r0, m1, r1, m2, r2,
  plano_reforco, acompanhamento, reuniao_pais, n_high + indicados AS alertas, muito_alto AS alertas_acompanhamento, n_high AS alertas_reuniao"""
_CUBE_SUMS = f"""count(*) FILTER (WHERE {HIGH}) AS n_high, count(*) FILTER (WHERE _risk_label = 'Médio') AS n_medium,
  count(*) FILTER (WHERE _risk_label = 'Regular') AS n_regular, count(*) AS total, coalesce(avg("INDE 22"), avg(_media)) AS m,
  count(*) FILTER (WHERE Matem < 6.0{D}) AS matematica, count(*) FILTER (WHERE Portug < 6.0{D}) AS portugues, count(*) FILTER (WHERE "Inglês" < 6.0{D}) AS ingles,
  {", ".join(f"coalesce(round_even(avg({chr(34)}{s}{chr(34)}), 2), 0.0{D}) AS m{i}, count(*) FILTER (WHERE {chr(34)}{s}{chr(34)} <= 2.0{D}) AS r{i}" for i, s in enumerate(("Pedra 20", "Pedra 21", "Pedra 22")))},
  count(*) FILTER (WHERE {HIGH} AND NOT {REC_FILLED}) AS plano_reforco, count(*) FILTER (WHERE {COHORT_FOLLOW}) AS acompanhamento,
  count(*) FILTER (WHERE {PARENT}) AS reuniao_pais, count(*) FILTER (WHERE {truthy_sql('Indicado')}) AS indicados,
  count(*) FILTER (WHERE _risk_label = 'Muito Alto') AS muito_alto"""
SQL["a6_cohort_cube"] = views() + f"""
SELECT ano, escola, por_ano, por_escola, {_CUBE} FROM (
  SELECT ano, escola, grouping(ano) = 0 AS por_ano, grouping(escola) = 0 AS por_escola, {_CUBE_SUMS}
  FROM (SELECT *, trim("Instituição de ensino") AS escola FROM sc) s GROUP BY GROUPING SETS ((ano, escola), (ano), (escola), ())) c"""
_PAGE = {"indicadores": ("n_high", "pct_high", "n_medium", "pct_medium", "n_regular", "pct_regular", "total"), "media_geral": ("media_geral",),
         "disciplinas": ("matematica", "portugues", "ingles"), "acoes": ("plano_reforco", "acompanhamento", "reuniao_pais"),
         "alertas": ("alertas", "alertas_acompanhamento", "alertas_reuniao")}
_PAGE_CELLS = [(t, c, c) for t, cols in _PAGE.items() for c in cols] + [("tendencia", f"{n} {s}", f"{v}{i}") for i, s in enumerate(("Pedra 20", "Pedra 21", "Pedra 22")) for n, v in (("media", "m"), ("risco", "r"))]
SQL["a6_dashboard"] = views(LONG).rstrip() + f""",
pg AS (SELECT {_CUBE} FROM (SELECT {_CUBE_SUMS} FROM sc WHERE ano = 1997) c)
""" + " UNION ALL ".join(f"SELECT '{t}' AS tabela, '{m}' AS medida, CAST({c} AS DOUBLE) AS valor FROM pg" for t, m, c in _PAGE_CELLS) + f"""
UNION ALL SELECT 'acoes', 'sem_progresso', CAST((SELECT count(*) FROM l1) AS DOUBLE)
UNION ALL SELECT 'acoes', 'proxima_fase', CAST((SELECT count(*) FROM l2) AS DOUBLE)
UNION ALL SELECT 'alunos_alto_risco', 'linhas', CAST(least(15, (SELECT count(*) FROM sc WHERE ano = 1997 AND {HIGH})) AS DOUBLE)
UNION ALL SELECT 'escolas', 'linhas', CAST((SELECT count(DISTINCT trim("Instituição de ensino")) FROM sc WHERE ano = 1997 AND trim("Instituição de ensino") <> '') AS DOUBLE)"""

# ---- the same results by an index or a store
for _name, _of in (("p2_indexed_search", "p2_search"), ("p4_indexed_search", "p4_search_pupils"), ("p6_store_lookup", "p6_lookup"),
                   ("j3_store_semi_join", "j3_semi_join"), ("a12_drift_profile", "a12_drift")):
    SQL[_name] = SQL[_of]
