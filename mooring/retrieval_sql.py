"""SQL of the retrieval queries, for DuckDB."""

from __future__ import annotations

from mooring.functions.text import TITLE_AROUND, TITLE_EQUAL, TITLE_INSIDE
from mooring.plans.preparation import ACCENTED, BASE, STOP_WORDS

WORD_SPLIT = r"[\s\pZ\x1c-\x1f\x{85}]+"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def _norm(x: str) -> str:
    return f"array_to_string({_words(x)}, ' ')"


def _overlap(q: str, t: str) -> str:
    a, b = f"list_distinct({_words(q)})", f"list_distinct({_words(t)})"
    return f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0 END)"


def _match(q: str, t: str) -> str:
    a, b = _norm(q), _norm(t)
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN {TITLE_EQUAL} WHEN contains({a}, {b}) THEN {TITLE_INSIDE}"
            f" WHEN contains({b}, {a}) THEN {TITLE_AROUND} ELSE 0.0 END)")



_JOINED = "(coalesce(title, '') || ' ' || coalesce(text, ''))"
_TITLE_AWARE = f"(0.30 * {_overlap('query', 'title')} + 0.25 * {_match('query', 'title')} + 0.45 * {_overlap('query', _JOINED)})"
_SAME_TITLE = f"(CASE WHEN {_norm('title')} = {_norm('subject')} AND {_norm('subject')} <> '' THEN 1.0 ELSE 0.0 END)"
_SUBJECT = f"(CASE WHEN subject IS NULL THEN {_TITLE_AWARE} ELSE 0.30 * {_TITLE_AWARE} + 0.70 * {_SAME_TITLE} END)"

NODES = rf"""
    entries AS (SELECT query_id, query, answer, unnest(nodes) AS n FROM examples WHERE query_id IS NOT NULL),
    merged AS (SELECT query_id, n.node_id AS node_id, max(query) AS query, max(answer) AS subject,
        coalesce(max(CASE WHEN n.relevance IS NULL THEN NULL WHEN isnan(n.relevance) THEN 0.0 ELSE greatest(n.relevance, 0.0) END), 1.0) AS score,
        max(n.text) AS text, max(n.metadata.title) AS title, coalesce(max(n.node_type), 'chunk') AS node_type, coalesce(bool_or(n.is_anchor_candidate), true) AS candidate,
        max(n.token_count) AS tok, max(n.embedding) AS embedding FROM entries WHERE n.node_id IS NOT NULL GROUP BY 1, 2),
    nodes_all AS (SELECT * EXCLUDE (tok), greatest(1, CASE WHEN coalesce(tok, 0) <> 0 THEN tok::BIGINT
        ELSE len(list_filter(string_split_regex(coalesce(text, ''), '{WORD_SPLIT}'), lambda w: w <> '')) END) AS tokens FROM merged)"""

UNIVERSE = NODES + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS idx, sum(score) OVER (PARTITION BY query_id) AS total,
        count(*) OVER (PARTITION BY query_id) AS n
        FROM (SELECT *, max(coalesce(len(embedding), 0)) OVER (PARTITION BY query_id) AS dim FROM nodes_all) WHERE len(embedding) = dim AND dim > 0),
    summed AS (SELECT *, CASE WHEN total <= 0 THEN 1.0 ELSE score END AS mass,
        sum(CASE WHEN total <= 0 THEN 1.0 ELSE score END) OVER (PARTITION BY query_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum FROM placed WHERE idx < 600),
    cut AS (SELECT * FROM summed WHERE round((cum - mass) / CASE WHEN total <= 0 THEN n::DOUBLE ELSE total END, 9) < 0.98)"""


def _rho(score: str, source: str = "cut") -> str:
    return (f"SELECT *, s / sum(s) OVER (PARTITION BY query_id) AS rho FROM (SELECT *, greatest(CASE WHEN isnan({score}) THEN 0.0 ELSE {score} END, 0.0) + 1e-8 AS s FROM {source})")


def _base(score: str = "score") -> str:
    return UNIVERSE + f""",
    massed AS ({_rho(score)}),
    uni AS (SELECT *, CASE WHEN bool_or(fits) OVER (PARTITION BY query_id) THEN fits ELSE true END AS eligible, tokens / 1000.0 AS cost
        FROM (SELECT *, candidate AND node_type IN ('chunk', 'sentence') AS fits FROM massed))"""

BASE_SQL = _base()


def _chances(score: str = "score") -> str:
    return _base(score) + """,
    chances AS (SELECT *, 0.85 * rho / sum(rho) OVER (PARTITION BY query_id) + 0.15 / count(*) OVER (PARTITION BY query_id) AS chance FROM uni WHERE eligible)"""


CHANCES = _chances()


def _samples(size: int, score: str = "score", seed: int = 42) -> str:
    return _chances(score) + f""",
    drawn AS (SELECT *, -ln((('0x' || substr(md5(concat_ws('|', query_id, node_id, sample::VARCHAR, '{seed}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / chance AS key
        FROM chances, range(5) r(sample)),
    samples AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY key, idx) <= {size})"""


def _cos(a: str, b: str) -> str:
    zero = " OR ".join(f"list_sum(list_transform({v}, lambda x: x * x)) = 0" for v in (a, b))
    return f"greatest(-1.0, least(1.0, CASE WHEN {zero} THEN 0.0 ELSE round(list_cosine_similarity({a}, {b}), 9) END))"


def _d(a: str, b: str) -> str:
    return f"(acos({_cos(a, b)}) / pi())"


def _around(n: str = "") -> str:
    """Distances to the anchors of the table ``anchors{n}``, and every node's nearest one."""
    return f"""
    to_anchor{n} AS (SELECT u.query_id, u.idx, a.pos, round(CASE WHEN u.idx = a.idx THEN 0.0 ELSE {_d('u.embedding', 'a.embedding')} END, 9) AS d, u.rho FROM uni u JOIN anchors{n} a USING (query_id)),
    nearest{n} AS (SELECT query_id, idx, min(d) AS near, arg_min(pos, struct_pack(d := d, pos := pos)) AS cell FROM to_anchor{n} GROUP BY 1, 2),
    anchored{n} AS (SELECT u.*, near, cell FROM uni u JOIN nearest{n} USING (query_id, idx))"""


ANCHORED = BASE_SQL + f""",
    anchors AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rho DESC, idx) - 1 AS pos, idx, embedding, cost FROM uni WHERE eligible
        QUALIFY pos < 3),{_around()}"""

FILL = "row_number() OVER (PARTITION BY query_id ORDER BY round(rho - {g} * near, 9) DESC, round(rho, 9) DESC, near, idx)"
PICKS = {
    "cell_top_rho": "SELECT query_id, cell AS pos, 0 AS place, idx FROM anchored QUALIFY row_number() OVER (PARTITION BY query_id, cell ORDER BY round(rho, 9) DESC, near, idx) = 1",
    "nearest": "SELECT query_id, pos, row_number() OVER (PARTITION BY query_id, pos ORDER BY d, round(rho, 9) DESC, idx) AS place, idx FROM to_anchor QUALIFY place <= 3",
    "old": """SELECT query_id, pos, row_number() OVER (PARTITION BY query_id, pos ORDER BY d, round(rho, 9) DESC, idx) AS place, idx
        FROM (SELECT * FROM to_anchor QUALIFY row_number() OVER (PARTITION BY query_id, pos ORDER BY d, idx) <= 8) QUALIFY place <= 3""",
}


def _turns(renderer: str) -> str:
    parts = ["SELECT query_id, idx, 0 AS phase, pos, 0 AS place FROM anchors"]
    if renderer in PICKS:
        parts.append(f"SELECT query_id, idx, 1, pos, place FROM ({PICKS[renderer]})")
    if renderer != "anchor_only":
        parts.append(f"SELECT query_id, idx, 2, 0, {FILL.format(g='0.0')} FROM anchored")
    return f"""
    offered AS ({' UNION ALL '.join(parts)}),
    once AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY query_id, idx ORDER BY phase, pos, place) = 1),
    turns AS (SELECT o.query_id, row_number() OVER (PARTITION BY o.query_id ORDER BY phase, pos, place, idx) AS turn, a.node_id, a.tokens, phase = 0 AS forced
        FROM once o JOIN anchored a USING (query_id, idx)),
    fold(query_id, turn, used, ids) AS (
        SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM turns
        UNION ALL
        SELECT f.query_id, t.turn, CASE WHEN t.forced OR (f.used + t.tokens <= 512 AND len(f.ids) < 8) THEN f.used + t.tokens ELSE f.used END,
            CASE WHEN t.forced OR (f.used + t.tokens <= 512 AND len(f.ids) < 8) THEN list_append(f.ids, t.node_id) ELSE f.ids END
        FROM fold f JOIN turns t ON t.query_id = f.query_id AND t.turn = f.turn + 1),
    shown AS (SELECT query_id, arg_max(ids, turn) AS context_node_ids, arg_max(used, turn) AS tokens FROM fold GROUP BY 1)"""


def _render(renderer: str) -> str:
    return f"WITH RECURSIVE {ANCHORED}, {_turns(renderer)} SELECT query_id, context_node_ids, tokens FROM shown"


GOLD = """
    gold AS (SELECT DISTINCT query_id, g AS node_id FROM (SELECT query_id, unnest(gold_node_ids) AS g FROM examples) WHERE query_id IS NOT NULL AND g IS NOT NULL),
    golds AS (SELECT query_id, list(node_id) AS ids FROM gold GROUP BY 1)"""

SCORES = NODES + f""", {GOLD},
    last AS (SELECT * FROM predictions WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY latency_ms DESC NULLS LAST,
        objective_after_refinement DESC NULLS LAST, objective_before_refinement DESC NULLS LAST, support_recall DESC NULLS LAST) = 1),
    base AS (SELECT q.query_id, coalesce(g.ids, []) AS gold_ids, p.query_id IS NULL AS missing, coalesce(p.anchor_node_ids, p.anchor_ids) IS NULL AS no_anchor,
        coalesce(p.context_node_ids, []) AS c, coalesce(p.anchor_node_ids, p.anchor_ids, []) AS a, p.latency_ms, p.objective_before_refinement AS ob, p.objective_after_refinement AS oa
        FROM (SELECT DISTINCT query_id FROM examples WHERE query_id IS NOT NULL) q LEFT JOIN golds g USING (query_id) LEFT JOIN last p USING (query_id)),
    raw_scores AS (SELECT *, CASE WHEN len(gold_ids) > 0 THEN len(list_intersect(list_distinct(c), gold_ids))::DOUBLE / len(gold_ids) END AS cr,
        CASE WHEN len(gold_ids) > 0 THEN len(list_intersect(list_distinct(a), gold_ids))::DOUBLE / len(gold_ids) END AS ar,
        CASE WHEN len(c) > 0 THEN len(list_intersect(list_distinct(c), gold_ids))::DOUBLE / len(list_distinct(c)) END AS cp,
        CASE WHEN len(a) > 0 THEN len(list_intersect(list_distinct(a), gold_ids))::DOUBLE / len(list_distinct(a)) END AS ap FROM base),
    context_tokens AS (SELECT b.query_id, sum(tokens)::DOUBLE AS t FROM (SELECT query_id, unnest(c) AS node_id FROM base) b JOIN nodes_all USING (query_id, node_id) GROUP BY 1),
    scores AS (SELECT r.*, coalesce(t, 0.0) AS tokens, CASE WHEN cr IS NOT NULL THEN (cr > 0)::DOUBLE END AS ch, CASE WHEN ar IS NOT NULL THEN (ar > 0)::DOUBLE END AS ah,
        CASE WHEN cr IS NOT NULL AND cp IS NOT NULL THEN CASE WHEN cr + cp > 0 THEN 2 * cr * cp / (cr + cp) ELSE 0.0 END END AS cf,
        CASE WHEN ar IS NOT NULL AND ap IS NOT NULL THEN CASE WHEN ar + ap > 0 THEN 2 * ar * ap / (ar + ap) ELSE 0.0 END END AS af
        FROM raw_scores r LEFT JOIN context_tokens USING (query_id))"""


def _finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def _spearman(source: str, x: str, y: str) -> str:
    return f"""
    pairs AS (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    ranks AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pairs),
    rho_row AS (SELECT CASE WHEN count(*) < 2 THEN 'need at least two objective/support pairs' WHEN min(x) = max(x) THEN 'objective values are constant'
        WHEN min(y) = max(y) THEN 'support values are constant' END AS reason, CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM ranks)"""


_MEANS = {
    "mean_context_recall": "coalesce(avg(cr), 0)", "mean_context_hit": "coalesce(avg(ch), 0)", "mean_context_precision": "avg(cp)", "mean_context_f1": "avg(cf)",
    "mean_anchor_recall": "coalesce(avg(ar), 0)", "mean_anchor_hit": "coalesce(avg(ah), 0)", "mean_anchor_precision": "avg(ap)", "mean_anchor_f1": "avg(af)",
    "mean_context_recall_per_node": "avg(cr / greatest(len(c), 1))", "mean_context_recall_per_1k_tokens": "avg(cr / greatest(tokens / 1000, 1e-12))",
    "mean_anchor_recall_per_anchor": "avg(ar / greatest(len(a), 1))", "anchor_non_empty_ratio": "avg((len(a) > 0)::DOUBLE)", "avg_context_size": "avg(len(c))",
    "avg_context_tokens": "avg(tokens)", "avg_latency_ms": f"coalesce(avg({_finite('latency_ms')}), 0)",
    "objective_before_refinement_mean": f"coalesce(avg({_finite('ob')}), 0)", "objective_after_refinement_mean": f"coalesce(avg({_finite('oa')}), 0)",
    "refinement_accept_rate": "0.0::DOUBLE",
}

_LISTED = """(CASE WHEN coalesce(possible_answers, '') = '' THEN [] WHEN regexp_matches(possible_answers, '^\\s*\\[') AND json_valid(possible_answers)
    THEN json_extract_string(possible_answers, '$[*]') ELSE [possible_answers] END)"""
_QA = f"""
    one_qa AS (SELECT * FROM qa WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY question) = 1),
    docs AS (SELECT node_id, arg_min(struct_pack(title := t, text := x), struct_pack(at := coalesce(added_at, TIMESTAMP '0001-01-01'), t := t, x := x)) AS r
        FROM (SELECT *, coalesce(title, '') AS t, coalesce(text, '') AS x FROM corpus) WHERE node_id IS NOT NULL AND (t <> '' OR x <> '') GROUP BY 1),
    doc AS (SELECT node_id, r.title AS title, r.text AS text FROM docs)"""
_GOLD_QA = _QA + """,
    support AS (SELECT id, pos, coalesce(p.title, '') AS title, coalesce(p.text, '') AS text
        FROM (SELECT id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) - 1 AS pos FROM one_qa) WHERE p.is_supporting),
    exact AS (SELECT title, text, min(node_id) AS exact FROM doc GROUP BY 1, 2),
    titled AS (SELECT title, min(node_id) AS titled FROM doc GROUP BY 1),
    aligned AS (SELECT id, pos, coalesce(exact, titled) AS node_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN titled IS NOT NULL THEN 'title' ELSE 'missing' END AS how
        FROM support LEFT JOIN exact USING (title, text) LEFT JOIN titled USING (title))"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TFIDF = rf"""
    texts AS (SELECT 'd' || node_id AS key, text FROM doc UNION ALL SELECT 'q' || id, coalesce(question, '') FROM one_qa),
    split AS (SELECT key, list_filter(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{BASE}'), '[\pL\pN_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM texts),
    grams AS (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM split),
    counts AS (SELECT key, term, count(*) AS tf FROM grams GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
    weights AS (SELECT key, term, tf * (ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + df)) + 1) AS w FROM counts JOIN dfs USING (term)),
    unit AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM weights),
    matches AS (SELECT substr(q.key, 2) AS id, substr(d.key, 2) AS node_id, sum(q.w * d.w) AS sim FROM unit q JOIN unit d ON q.term = d.term AND q.key[1] = 'q' AND d.key[1] = 'd' GROUP BY 1, 2),
    sims AS (SELECT id, node_id, coalesce(sim, 0.0) AS sim FROM (SELECT id FROM one_qa) CROSS JOIN (SELECT node_id FROM doc) LEFT JOIN matches USING (id, node_id)),
    top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, node_id) AS place FROM sims QUALIFY place <= 10)"""
_MERGE = """
    golden AS (SELECT DISTINCT id, node_id, true AS is_gold FROM aligned WHERE node_id IS NOT NULL),
    joined AS (SELECT id, node_id, sim, place, coalesce(is_gold, false) AS is_gold FROM top FULL JOIN golden USING (id, node_id)),
    counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, count_if(is_gold) OVER (PARTITION BY id) AS g,
        row_number() OVER (PARTITION BY id, is_gold ORDER BY place NULLS LAST, node_id) AS r FROM joined),
    kept AS (SELECT id, node_id, is_gold, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN n > 10 THEN NOT is_gold ELSE false END, place NULLS LAST, node_id) - 1 AS place
        FROM counted WHERE n <= 10 OR is_gold OR r <= 10 - g)"""
_ANSWERS = f"""
    answered AS (SELECT *, {_LISTED} AS possible FROM one_qa),
    first_answer AS (SELECT *, coalesce(nullif(obj, ''), nullif(final_answer, ''), nullif(possible[1], '')) AS answer FROM answered)"""


def _pairs(metric: str) -> str:
    d = _d("a.embedding", "b.embedding") if metric == "angular" else f"(1 - {_cos('a.embedding', 'b.embedding')})"
    places = 6 if metric == "angular" else 9
    return f"WITH {BASE_SQL} SELECT a.query_id, a.idx AS i, b.idx AS j, round({d}, {places}) AS d FROM uni a JOIN uni b ON a.query_id = b.query_id AND a.idx < b.idx"


_DIST = f"""
    dist AS (SELECT a.query_id, a.sample, a.idx AS a, a.cost AS ca, v.idx AS v, v.rho AS mass, round(CASE WHEN a.idx = v.idx THEN 0.0 ELSE {_d('a.embedding', 'v.embedding')} END, 9) AS d
        FROM samples a JOIN samples v USING (query_id, sample))"""
_BEST1 = """
    sums AS (SELECT query_id, sample, a, NULL::BIGINT AS b, round(sum(mass * d) + 0.03 * any_value(ca) + 0.01, 9) AS total FROM dist GROUP BY 1, 2, 3)"""
_BEST2 = """
    sums AS (SELECT x.query_id, x.sample, x.a, y.a AS b, round(sum(x.mass * least(x.d, y.d)) + 0.03 * (any_value(x.ca) + any_value(y.ca)) + 0.02, 9) AS total
        FROM dist x JOIN dist y ON x.query_id = y.query_id AND x.sample = y.sample AND x.v = y.v AND x.a < y.a GROUP BY 1, 2, 3, 4)"""


def _best(size: int, sums: str) -> str:
    return f"""WITH {_samples(size)}, {_DIST}, {sums}
SELECT query_id, sample, a, b, total FROM sums QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY total, a, b) = 1"""


def _mass(score: str) -> str:
    return f"WITH {UNIVERSE}, m AS ({_rho(score)}) SELECT query_id, idx, node_id, round(rho, 9) AS rho FROM m"




def _total(n: str) -> str:
    return f"""
    total{n} AS (SELECT query_id, c + 0.03 * t AS total FROM (SELECT query_id, sum(rho * near) AS c FROM anchored{n} GROUP BY 1)
        JOIN (SELECT query_id, sum(cost) AS t FROM anchors{n} GROUP BY 1) USING (query_id))"""


#: A greedy search of three anchors, for samples of more than five nodes.
_GREEDY = """
    g1 AS (SELECT * FROM (SELECT query_id, sample, a AS a0, round(sum(mass * d) + 0.03 * any_value(ca), 9) AS s FROM dist GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY s, a0) = 1),
    near1 AS (SELECT d.query_id, d.sample, v, d FROM dist d JOIN g1 ON d.query_id = g1.query_id AND d.sample = g1.sample AND d.a = a0),
    g2 AS (SELECT * FROM (SELECT d.query_id, d.sample, a AS a1, round(sum(mass * least(d.d, n.d)) + 0.03 * any_value(ca), 9) AS s FROM dist d JOIN near1 n USING (query_id, sample, v)
        JOIN g1 USING (query_id, sample) WHERE a <> a0 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY s, a1) = 1),
    near2 AS (SELECT d.query_id, d.sample, d.v, least(d.d, n.d) AS d FROM dist d JOIN g2 ON d.query_id = g2.query_id AND d.sample = g2.sample AND d.a = a1
        JOIN near1 n ON n.query_id = d.query_id AND n.sample = d.sample AND n.v = d.v),
    g3 AS (SELECT * FROM (SELECT d.query_id, d.sample, a AS a2, round(sum(mass * least(d.d, n.d)) + 0.03 * any_value(ca), 9) AS s FROM dist d JOIN near2 n USING (query_id, sample, v)
        JOIN g1 USING (query_id, sample) JOIN g2 USING (query_id, sample) WHERE a <> a0 AND a <> a1 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY s, a2) = 1),
    grown AS (SELECT query_id, sample, list_sort([a0, a1, a2]) AS l FROM g1 JOIN g2 USING (query_id, sample) JOIN g3 USING (query_id, sample)),
    sizes_of AS (SELECT query_id, sample, count(*) AS n FROM samples GROUP BY 1, 2),
    picked AS (SELECT query_id, sample, CASE WHEN n > 5 THEN l[1] ELSE a0 END AS a0, CASE WHEN n > 5 THEN l[2] ELSE a1 END AS a1, CASE WHEN n > 5 THEN l[3] ELSE a2 END AS a2
        FROM picked_exact FULL JOIN grown USING (query_id, sample) JOIN sizes_of USING (query_id, sample)),"""


def _searched(k: int, variant: str, renderer: str, score: str = "score", seed: int = 42, greedy: bool = False) -> str:
    """A run with sampling: search of every sample by joins, choice of a sample, and one
    refinement step; queries with at most k candidates take them all."""
    names, tables = [f"a{i}" for i in range(k)], [f"x{i}" for i in range(k)]
    joins = " ".join(f"JOIN dist {t} ON {t}.query_id = x0.query_id AND {t}.sample = x0.sample AND {t}.v = x0.v AND {t}.a > {p}.a" for p, t in zip(tables, tables[1:]))
    least, price = ", ".join(f"{t}.d" for t in tables), " + ".join(f"any_value({t}.ca)" for t in tables)
    choose = ("SELECT query_id, sample FROM picked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total, sample) = 1" if variant == "sample_only" else
              """SELECT query_id, sample FROM (SELECT query_id, sample, round(sum(rho * near) + 0.03 * any_value(t), 9) AS total FROM (
            SELECT m.query_id, m.sample, u.idx, any_value(u.rho) AS rho, min(CASE WHEN u.idx = m.idx THEN 0.0 ELSE """ + _d("u.embedding", "m.embedding") + """ END) AS near, sum(m.cost) AS t
            FROM members m JOIN uni u USING (query_id) GROUP BY 1, 2, 3) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total, sample) = 1""")
    refine = "refine" in variant
    step = f"""
    costs AS (SELECT u.query_id, u.cell, u.idx, any_value(u.cost) AS cost, sum(v.rho * CASE WHEN u.idx = v.idx THEN 0.0 ELSE {_d('u.embedding', 'v.embedding')} END) AS c
        FROM anchored0 u JOIN anchored0 v ON u.query_id = v.query_id AND u.cell = v.cell WHERE u.eligible GROUP BY 1, 2, 3),
    best AS (SELECT query_id, cell AS pos, idx FROM costs QUALIFY row_number() OVER (PARTITION BY query_id, cell ORDER BY round(c + 0.03 * cost, 9), idx) = 1),
    anchors1 AS (SELECT p.query_id, p.pos, u.idx, u.embedding, u.cost FROM (SELECT a.query_id, a.pos, coalesce(b.idx, a.idx) AS idx FROM anchors0 a LEFT JOIN best b USING (query_id, pos)) p
        JOIN uni u USING (query_id, idx)),{_around('1')},{_total('1')},
    moved AS (SELECT query_id, total1.total < total0.total - 1e-12 AS better FROM total0 JOIN total1 USING (query_id)),
    anchors AS (SELECT a.* FROM anchors1 a JOIN moved USING (query_id) WHERE better UNION ALL SELECT a.* FROM anchors0 a JOIN moved USING (query_id) WHERE NOT better),"""
    # greedy search needs no combinations of large samples
    few = " AND (SELECT count(*) FROM samples s WHERE s.query_id = x0.query_id AND s.sample = x0.sample) <= 5" if greedy else ""
    exact = "true" if not greedy else "(SELECT count(*) FROM uni u WHERE u.query_id = shown.query_id AND u.eligible) <= 5"
    return f"""WITH RECURSIVE {_samples(min(48, 12 * k), score, seed)},
    enough AS (SELECT query_id, count(*) > {k} AS more FROM uni WHERE eligible GROUP BY 1),
    dist AS (SELECT a.query_id, a.sample, a.idx AS a, a.cost AS ca, v.idx AS v, v.rho AS mass, CASE WHEN a.idx = v.idx THEN 0.0 ELSE {_d('a.embedding', 'v.embedding')} END AS d
        FROM samples a JOIN samples v USING (query_id, sample) JOIN enough USING (query_id) WHERE more),
    sums AS (SELECT x0.query_id, x0.sample, {', '.join(f'{t}.a AS {n}' for t, n in zip(tables, names))}, round(sum(x0.mass * least({least})) + 0.03 * ({price}), 9) AS total
        FROM dist x0 {joins} {few} GROUP BY 1, 2, {', '.join(f'{t}.a' for t in tables)}),
    {'picked_exact' if greedy else 'picked'} AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY query_id, sample ORDER BY total, {', '.join(names)}) = 1),{_GREEDY if greedy else ''}
    members AS (SELECT l.query_id, l.sample, l.pos, u.idx, u.embedding, u.cost FROM ({' UNION ALL '.join(f'SELECT query_id, sample, {n} AS idx, {i} AS pos FROM picked' for i, n in enumerate(names))}) l JOIN uni u USING (query_id, idx)),
    chosen AS ({choose}),
    anchors0 AS (SELECT m.query_id, m.pos, m.idx, m.embedding, m.cost FROM members m JOIN chosen USING (query_id, sample)
        UNION ALL SELECT u.query_id, row_number() OVER (PARTITION BY u.query_id ORDER BY u.idx) - 1, u.idx, u.embedding, u.cost FROM uni u JOIN enough USING (query_id) WHERE eligible AND NOT more),
    {_around('0')},{_total('0')},{step if refine else 'anchors AS (SELECT * FROM anchors0),'}
    {_around()},{_total('')}, {_turns(renderer)}, {GOLD},
    listed AS (SELECT a.query_id, list(u.node_id ORDER BY a.pos) AS anchor_node_ids FROM anchors a JOIN uni u ON a.query_id = u.query_id AND a.idx = u.idx GROUP BY 1),
    sizes AS (SELECT query_id, count(*) AS nodes FROM uni GROUP BY 1)
SELECT query_id, anchor_node_ids, context_node_ids, round(total0.total, 6) AS before, round(total.total, 6) AS after,
    CASE WHEN ids IS NOT NULL THEN round(len(list_intersect(context_node_ids, ids))::DOUBLE / len(ids), 6) END AS support_recall,
    CASE WHEN ids IS NOT NULL THEN (len(list_intersect(context_node_ids, ids)) > 0)::DOUBLE END AS support_hit, {exact} AS exact_phase1, nodes, tokens, len(anchor_node_ids) AS k, total.total AS objective
FROM shown JOIN sizes USING (query_id) JOIN listed USING (query_id) JOIN total0 USING (query_id) JOIN total USING (query_id) LEFT JOIN golds USING (query_id)"""


def _fixed(sql: str) -> str:
    return f"SELECT * EXCLUDE (objective) FROM ({sql})"


def _best_k(penalty: float) -> str:
    """The best of runs with k from 1 to 4, the smaller k on ties."""
    runs = " UNION ALL ".join(f"SELECT *, {k} AS turn FROM ({_searched(k, 'sample_full_validation_refine', 'old', seed=42 + 1009 * k)})" for k in range(1, 5))
    return f"""SELECT * EXCLUDE (objective, turn) FROM ({runs})
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(objective + {penalty} * k, 9), turn) = 1"""


ORACLES = {
    "lexical_overlap_topn": f"""WITH {NODES}, o AS (SELECT query_id, node_id, {_overlap('query', 'text')} AS s FROM nodes_all)
SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS place, round(s, 6) AS overlap FROM o QUALIFY place <= 5""",
    "title_match_class": f"WITH {NODES} SELECT query_id, node_id, {_norm('title')} AS title, {_match('query', 'title')}::DOUBLE AS score FROM nodes_all",
    "relevance_mass_current": _mass("score"),
    "title_aware_mass": _mass(_TITLE_AWARE),
    "subject_title_mass": _mass(_SUBJECT),
    "universe_mass_cutoff": f"WITH {UNIVERSE} SELECT query_id, idx, node_id, score, tokens FROM cut",
    "candidate_filter_fallback": f"""WITH {BASE_SQL}, f AS (SELECT query_id, idx, candidate AND node_type = 'sentence' AS ok FROM uni)
SELECT query_id, idx, CASE WHEN bool_or(ok) OVER (PARTITION BY query_id) THEN ok ELSE true END AS eligible FROM f""",
    "sample_probabilities": f"WITH {CHANCES} SELECT query_id, idx, round(chance, 9) AS chance FROM chances",
    "weighted_samples": f"WITH {_samples(36)} SELECT query_id, sample, idx, node_id FROM samples",
    "angular_distance": _pairs("angular"),
    "cosine_distance": _pairs("cosine"),
    "top_rho_anchors": f"WITH {ANCHORED} SELECT query_id, pos, idx FROM anchors",
    "objective_given_anchors": f"""WITH {ANCHORED}, cover AS (SELECT query_id, sum(rho * near) AS coverage FROM anchored GROUP BY 1),
    price AS (SELECT query_id, 0.03 * sum(cost) AS token_penalty, 0.01 * count(*) AS anchor_penalty FROM anchors GROUP BY 1)
SELECT query_id, round(coverage, 9) AS coverage, round(token_penalty, 9) AS token_penalty, round(anchor_penalty::DOUBLE, 9) AS anchor_penalty,
    round(coverage + token_penalty + anchor_penalty, 9) AS total FROM cover JOIN price USING (query_id)""",
    "exact_k1_search": _best(12, _BEST1),
    "exact_k2_search": _best(24, _BEST2),
    "assign_nearest_anchor": f"WITH {ANCHORED} SELECT query_id, idx, cell, round(near, 6) AS d FROM anchored",
    "cluster_sizes": f"WITH {ANCHORED} SELECT a.query_id, a.pos, count(n.idx) AS size FROM anchors a LEFT JOIN anchored n ON n.query_id = a.query_id AND n.cell = a.pos GROUP BY 1, 2",
    "cell_top_rho_pick": f"WITH {ANCHORED} SELECT query_id, pos, idx FROM ({PICKS['cell_top_rho']})",
    "nearest_per_anchor": f"WITH {ANCHORED} SELECT query_id, pos, place, idx FROM ({PICKS['nearest']})",
    "score_fill_order": f"WITH {ANCHORED} SELECT query_id, idx, {FILL.format(g='0.5')} AS place FROM anchored",
    "refine_one_step": f"""WITH {ANCHORED},
    costs AS (SELECT u.query_id, u.cell, u.idx, any_value(u.cost) AS cost, sum(v.rho * round(CASE WHEN u.idx = v.idx THEN 0.0 ELSE {_d('u.embedding', 'v.embedding')} END, 9)) AS c
        FROM anchored u JOIN anchored v ON u.query_id = v.query_id AND u.cell = v.cell WHERE u.eligible GROUP BY 1, 2, 3),
    best AS (SELECT query_id, cell AS pos, idx FROM costs QUALIFY row_number() OVER (PARTITION BY query_id, cell ORDER BY round(c + 0.03 * cost, 9), idx) = 1)
SELECT a.query_id, a.pos, a.idx AS old_idx, coalesce(b.idx, a.idx) AS new_idx FROM anchors a LEFT JOIN best b ON a.query_id = b.query_id AND a.pos = b.pos""",
    **{f"render_{r}": _render(r) for r in ("anchor_only", "global_top_rho", "nearest", "cell_top_rho", "old")},
    "render_text": f"""WITH {ANCHORED}
SELECT a.query_id, string_agg('[' || (a.pos + 1) || '] ' || coalesce(nullif(u.title, ''), u.node_id) || chr(10) || 'node_id: ' || u.node_id || chr(10) || coalesce(u.text, ''), chr(10) || chr(10) ORDER BY a.pos) AS text
FROM anchors a JOIN uni u ON a.query_id = u.query_id AND a.idx = u.idx GROUP BY 1""",
    "retrieval_top_rho": f"""WITH RECURSIVE {ANCHORED}, {_turns('global_top_rho')}, {GOLD},
    cover AS (SELECT query_id, sum(rho * near) AS coverage, count(*) AS nodes FROM anchored GROUP BY 1),
    price AS (SELECT a.query_id, 0.03 * sum(a.cost) AS p, list(u.node_id ORDER BY a.pos) AS anchor_node_ids FROM anchors a JOIN uni u ON a.query_id = u.query_id AND a.idx = u.idx GROUP BY 1)
SELECT query_id, anchor_node_ids, context_node_ids, round(coverage + p, 6) AS before, round(coverage + p, 6) AS after,
    CASE WHEN ids IS NOT NULL THEN round(len(list_intersect(context_node_ids, ids))::DOUBLE / len(ids), 6) END AS support_recall,
    CASE WHEN ids IS NOT NULL THEN (len(list_intersect(context_node_ids, ids)) > 0)::DOUBLE END AS support_hit, true AS exact_phase1, nodes, tokens, len(anchor_node_ids) AS k
FROM shown JOIN cover USING (query_id) JOIN price USING (query_id) LEFT JOIN golds USING (query_id)""",
    "retrieval_sample_only": _fixed(_searched(2, "sample_only", "old")),
    "retrieval_full_validation": _fixed(_searched(2, "sample_full_validation", "old")),
    "retrieval_refine": _fixed(_searched(3, "sample_full_validation_refine", "old")),
    "retrieval_refine_cell": _fixed(_searched(3, "sample_full_validation_refine", "cell_top_rho")),
    "retrieval_title_aware": _fixed(_searched(3, "sample_full_validation_refine", "nearest", _TITLE_AWARE)),
    "retrieval_subject_title": _fixed(_searched(2, "sample_full_validation_refine", "old", _SUBJECT)),
    "retrieval_greedy": _fixed(_searched(3, "sample_full_validation_refine", "old", greedy=True)),
    "retrieval_auto_k": _best_k(0.0),
    "retrieval_adaptive_k": _best_k(0.01),
    "prediction_last_row": f"WITH {SCORES} SELECT query_id, latency_ms, objective_after_refinement FROM last",
    "context_metrics": f"WITH {SCORES} SELECT query_id, round(cr, 6) AS recall, ch AS hit, round(cp, 6) AS precision, round(cf, 6) AS f1, len(c)::DOUBLE AS size, tokens FROM scores",
    "anchor_metrics": f"WITH {SCORES} SELECT query_id, round(ar, 6) AS recall, ah AS hit, round(ap, 6) AS precision, round(af, 6) AS f1, len(a)::DOUBLE AS size FROM scores",
    "eval_summary": f"""WITH {SCORES}, {_spearman('scores', _finite('oa'), 'cr')}
SELECT count(*) AS num_queries, count_if(missing)::BIGINT AS missing_prediction_count, count_if(no_anchor)::BIGINT AS missing_anchor_key_count,
    {', '.join(f'round({e}, 6) AS {n}' for n, e in _MEANS.items())}, (SELECT round(spearman, 6) FROM rho_row) AS objective_support_spearman FROM scores""",
    "objective_spearman": f"WITH {SCORES}, {_spearman('last', 'latency_ms', 'support_recall')} SELECT round(spearman, 6) AS spearman, reason FROM rho_row",
    "validate_counts_dims": """SELECT count(*) AS num_rows, count(DISTINCT query_id) AS num_queries,
    (SELECT list_sort(list_distinct(list(len(n.embedding)))) FROM (SELECT unnest(nodes) AS n FROM examples)) AS dims FROM examples""",
    "qa_answers": f"""WITH all_qa AS (SELECT *, {_LISTED} AS possible FROM qa), f AS (SELECT *, coalesce(nullif(obj, ''), nullif(final_answer, ''), nullif(possible[1], '')) AS answer FROM all_qa),
    u AS (SELECT id, answer, list_filter(list_concat([answer, obj], possible), lambda x: x IS NOT NULL AND x <> '') AS l FROM f)
SELECT id, answer, list_filter(l, lambda x, i: list_position(l, x) = i) AS answers FROM u""",
    "gold_alignment": f"WITH {_GOLD_QA} SELECT id, pos, node_id, how FROM aligned",
    "gold_counts": f"WITH {_GOLD_QA} SELECT count(*) AS total_gold, count_if(how = 'missing')::BIGINT AS missing_gold FROM aligned",
    "tfidf_topn": f"WITH {_QA}, {_TFIDF} SELECT id, node_id, round(sim, 6) AS sim, place FROM top",
    "universe_merge": f"WITH {_GOLD_QA}, {_TFIDF}, {_MERGE} SELECT id, node_id, is_gold, place FROM kept",
    "latent_lengths": f"""WITH {_QA}, {_TFIDF.split('weights AS')[0].rstrip().rstrip(',')},
    kept AS (SELECT term FROM counts GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 50000),
    worded AS (SELECT DISTINCT substr(key, 2) AS node_id FROM counts JOIN kept USING (term) WHERE key[1] = 'd')
SELECT node_id, 32::BIGINT AS elements, CASE WHEN worded.node_id IS NULL THEN 0.0 ELSE 1.0 END AS length FROM doc LEFT JOIN worded USING (node_id)""",
    "prepared_examples": f"""WITH {_GOLD_QA}, {_TFIDF}, {_MERGE}, {_ANSWERS},
    lists AS (SELECT id, list(node_id ORDER BY place) AS node_ids FROM kept GROUP BY 1),
    first_gold AS (SELECT id, node_id, min(pos) AS pos FROM aligned WHERE node_id IS NOT NULL GROUP BY 1, 2),
    gold_lists AS (SELECT id, list(node_id ORDER BY pos) AS gold_node_ids FROM first_gold GROUP BY 1)
SELECT id AS query_id, coalesce(question, '') AS query, answer, node_ids, coalesce(gold_node_ids, []) AS gold_node_ids, len(node_ids) AS nodes
FROM first_answer JOIN lists USING (id) LEFT JOIN gold_lists USING (id)""",
}
