"""Queries of marks, findings, lines, labels, undo and wording, each with its SQL. They are registered with the others in
``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from ..operators import changes, compare, layout, placing, proof, relations, review
from ..sources import load
from ..storage import once, spread
from .queries import _ROWS, _order_rows, _text, edited_rows, query, table

# ------------------------------------------------------------------ marks and findings on rows


def _marked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of exact edits with hunks, both streams' blocks, and a mark on each side from a third of the stream on."""
    rows = once(relations.with_hunks(edited_rows(spark, sf_dir)).withColumn("l_text", _text("l_body")).withColumn("r_text", _text("r_body")), "marked")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{c}_block").alias("block_id"), F.col(f"{c}i").alias("pos"), F.col(f"{c}_text").alias("text")) for s, c in (("a", "l"), ("b", "r"))])
    blocks = rows.select("pair_id", F.inline(sides)).filter("block_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    blocks = blocks.withColumn("doc", F.concat_ws("|", "pair_id", "side"))
    placed = once(relations.stream_offsets(blocks, "doc").drop("doc"), "streams")
    size = placed.groupBy("pair_id", "side").agg(F.max(F.col("start") + F.length("text")).alias("n"))
    start = F.floor(F.col("n") / 3)
    marks = size.select(F.concat_ws("|", "pair_id", "side").alias("mark_id"), "pair_id", "side", start.alias("start"), F.least(start + 200, F.col("n")).alias("end"))
    return rows, placed, marks.filter("end > start")


_STREAMS = f"""{_ROWS},
  sides AS (SELECT pair_id, 'a' AS side, row_no, hunk, li AS pos, l_text AS text FROM numbered WHERE l_text IS NOT NULL
    UNION ALL SELECT pair_id, 'b', row_no, hunk, ri, r_text FROM numbered WHERE r_text IS NOT NULL),
  starts AS (SELECT *, (coalesce(sum(length(text) + 1) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM sides),
  sized AS (SELECT pair_id, side, max(start + length(text)) AS n FROM starts GROUP BY ALL),
  marks AS (SELECT pair_id, side, n // 3 AS s, least(n // 3 + 200, n) AS e FROM sized WHERE least(n // 3 + 200, n) > n // 3),
  parts AS (SELECT m.pair_id, m.side, pos, row_no, hunk, greatest(s, start) - start AS seg_start, least(e, start + length(text)) - start AS seg_end
    FROM marks m JOIN starts USING (pair_id, side) WHERE start < e AND start + length(text) > s)"""


def _row_no(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", F.col("key").alias("row_key"), "row_no")


@query(f"""WITH {_STREAMS}, first AS (SELECT pair_id, side, arg_min(row_no, pos) AS row_no, arg_min(hunk, pos) AS hunk FROM parts GROUP BY ALL)
  SELECT m.pair_id, m.side, row_no IS NOT NULL AS found, coalesce(hunk, -1)::INT AS hunk, row_no FROM marks m LEFT JOIN first USING (pair_id, side)""")
def marks_placed(spark, sf_dir):
    rows, blocks, marks = _marked(spark, sf_dir)
    placed, _ = placing.place_text_marks(marks, blocks, rows)
    return placed.join(_row_no(rows), ["pair_id", "row_key"], "left").select("pair_id", "side", "found", "hunk", "row_no")


@query(f"WITH {_STREAMS} SELECT pair_id, side, row_no, pos, seg_start, seg_end FROM parts")
def mark_parts(spark, sf_dir):
    rows, blocks, marks = _marked(spark, sf_dir)
    _, parts = placing.place_text_marks(marks, blocks, rows)
    key = F.split("mark_id", "[|]")
    return parts.withColumn("pair_id", key[0]).withColumn("side", key[1]).join(_row_no(rows), ["pair_id", "row_key"]).select("pair_id", "side", "row_no", "pos", "seg_start", "seg_end")


@query(f"""WITH {_ROWS}, first AS (SELECT pair_id, hunk, min(row_no) AS row_no FROM numbered WHERE hunk >= 0 GROUP BY ALL),
  asked AS (SELECT pair_id, unnest([0, 2, -1]) AS hunk FROM (SELECT DISTINCT pair_id FROM rows))
  SELECT pair_id, hunk, hunk >= 0 AS found, row_no FROM asked LEFT JOIN first USING (pair_id, hunk)""")
def change_marks_placed(spark, sf_dir):
    rows = once(relations.with_hunks(edited_rows(spark, sf_dir)), "marked")
    asked = rows.select("pair_id").distinct().select("pair_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(-1))).alias("hunk"))
    marks = asked.select(F.concat_ws("|", "pair_id", "hunk").alias("mark_id"), "pair_id", "hunk")
    return placing.place_change_marks(marks, rows).join(_row_no(rows), ["pair_id", "row_key"], "left").select("pair_id", "hunk", "found", "row_no")


def _issues(rows: DataFrame) -> DataFrame:
    """Every "th" of the texts of rows as a finding, and every word "the" as another."""
    texts = rows.select(F.explode(F.array("l_text", "r_text")).alias("text")).filter("text <> ''").distinct()
    places = lambda p: F.filter(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0))), lambda i: F.substr(F.col("text"), i + 1, F.lit(len(p))) == p)
    each = lambda p, rule: texts.select("text", F.lit("local").alias("source"), F.lit(rule).alias("rule"), F.explode(places(p)).alias("start")).withColumn("end", F.col("start") + len(p))
    return each("th", "pair").union(each(" the ", "word"))


def _issue_rows(spark, sf_dir) -> DataFrame:
    rows = once(edited_rows(spark, sf_dir).withColumn("l_text", _text("l_body")).withColumn("r_text", _text("r_body")), "issues")
    mono = rows.filter("CAST(pair_id AS long) % 7 = 0").select("pair_id", F.lit("b").alias("side"))
    return placing.place_issues(rows, _issues(rows), mono).join(_row_no(rows), ["pair_id", "row_key"])


_ISSUES = f"""{_ROWS},
  texts AS (SELECT pair_id, row_no, 'a' AS side, l_text AS text FROM rows WHERE l_text <> '' UNION ALL SELECT pair_id, row_no, 'b', r_text FROM rows WHERE r_text <> '' AND pair_id::BIGINT % 7 <> 0),
  issues AS (SELECT pair_id, row_no, side, rule, unnest(list_filter(range(length(text)), lambda i: substr(text, i + 1, length(p)) = p)) AS start, length(p) AS n
    FROM texts, (VALUES ('pair', 'th'), ('word', ' the ')) r(rule, p))""".replace("texts AS (SELECT doc_id", "lines_ AS (SELECT doc_id").replace("FROM texts WHERE trim(line)", "FROM lines_ WHERE trim(line)")


@query(f"""WITH {_ISSUES} SELECT pair_id, side, row_no, rule, start::INT AS start, (start + n)::INT AS "end" FROM issues""")
def issues_placed(spark, sf_dir):
    return _issue_rows(spark, sf_dir).select("pair_id", "side", "row_no", "rule", "start", "end")


@query(f"WITH {_ISSUES} SELECT pair_id, count_if(side = 'a') AS a, count_if(side = 'b') AS b FROM issues GROUP BY pair_id")
def issue_counts(spark, sf_dir):
    return placing.count_issues(_issue_rows(spark, sf_dir))


# ------------------------------------------------------------------ places in documents


_LINE_STARTS = """l AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
  o AS (SELECT doc_id, pos, line, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM l)"""


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@query(f"""WITH {_LINE_STARTS}, p AS (SELECT doc_id, k AS point_id, k * 97 - 5 AS "at" FROM documents, range(0, 40) r(k))
  SELECT p.doc_id, point_id, "at", coalesce(max(pos) FILTER (start <= "at"), 0)::INT AS pos FROM p JOIN o USING (doc_id) GROUP BY ALL""")
def blocks_at_points(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("point_id")).withColumn("at", F.col("point_id") * 97 - 5)
    return placing.blocks_at(points, relations.stream_offsets(_lines(spark, sf_dir)))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS number
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE (l_orderkey + l_linenumber) % 3 <> 0""")
def block_numbers(spark, sf_dir):
    kind = F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, "marker").otherwise("p")
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).distinct().withColumn("type", kind)
    return placing.numbering(blocks).select("doc_id", "pos", "number")


# ------------------------------------------------------------------ lines, lengths and labels


def _order_tables(spark, sf_dir) -> DataFrame:
    """Orders of a customer as a table on either side: a row in five is changed, one in five is gone."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL")
    same, now = _order_rows(F.col("o_orderstatus")), _order_rows(F.when(F.col("o_orderkey") % 5 == 1, "X").otherwise(F.col("o_orderstatus")))
    tables = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(same)).alias("a"), F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 5 != 0, now))).alias("b"))
    body = lambda c: F.to_json(F.struct(F.lit("table").alias("type"), F.transform(c, lambda r: r["row"]).alias("rows")))
    return tables.select("o_custkey", body("a").alias("a"), body("b").alias("b"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))


@query("""WITH o AS (SELECT o_custkey, length(o_orderkey::VARCHAR) + length(o_orderstatus) + 10 AS n FROM orders)
  SELECT o_custkey, 3 AS columns, sum(n)::INT AS length, max(n)::INT AS widest FROM o GROUP BY o_custkey""")
def table_shapes(spark, sf_dir):
    shaped = _order_tables(spark, sf_dir).select("o_custkey", layout.columns_of(F.col("a")).alias("columns"), layout.lengths("a").alias("n"))
    return shaped.select("o_custkey", "columns", F.col("n")[0].alias("length"), F.array_max(F.slice("n", 2, F.size("n"))).alias("widest"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'mod' ELSE 'eq' END AS kind, length(o_orderkey::VARCHAR) + length(o_orderstatus) + 10 AS n,
    length(o_orderkey::VARCHAR) + 1 + 10 AS m FROM orders),
  t AS (SELECT o_custkey FROM o GROUP BY o_custkey HAVING count_if(kind <> 'eq') > 0 AND count_if(kind <> 'del') > 0),
  r AS (SELECT *, row_number() OVER w AS line_no, count(*) OVER (PARTITION BY o_custkey) AS all_ FROM o JOIN t USING (o_custkey) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT o_custkey::VARCHAR AS pair_id, line_no::INT AS line_no, 't' || kind AS kind, CASE line_no WHEN 1 THEN 't-first' WHEN all_ THEN 't-last' ELSE '' END AS extra,
    nullif(kind, 'eq') AS act, n::INT AS la, (CASE kind WHEN 'del' THEN 0 WHEN 'mod' THEN m ELSE n END)::INT AS lb,
    CASE kind WHEN 'del' THEN 'Remove from A (this row)' WHEN 'mod' THEN 'Use B’s version in A (this row)' END AS to_a FROM r
  UNION ALL SELECT o_custkey::VARCHAR, 0, 'tcap', '', 'mod', 0, 0, 'Use B’s version in A (whole table)' FROM t""")
def table_lines(spark, sf_dir):
    block = lambda c, name: F.array(F.struct(F.lit(name).alias("id"), F.col(c).alias("body"))).alias(name)
    both = _order_tables(spark, sf_dir).filter("n_b > 0").select(F.col("o_custkey").cast("string").alias("pair_id"), block("a", "left"), block("b", "right"))
    rows = once(compare.compare_pairs(both), "compared").filter("kind = 'table'")
    lines = layout.line_parts(rows, compare.compare_table_rows(rows))
    to_a, _ = layout.act_labels(F.col("act"), F.col("sub"), F.col("whole_table"))
    return lines.select("pair_id", "line_no", "kind", "extra", "act", "la", "lb", F.when(F.col("act").isNotNull(), to_a).alias("to_a"))


@query(f"""WITH {_ROWS} SELECT pair_id, row_no, kind, nullif(kind, 'eq') AS act, (CASE WHEN l_text IS NULL THEN 0 ELSE length(l_text) END)::INT AS la,
  (CASE WHEN r_text IS NULL THEN 0 ELSE length(r_text) END)::INT AS lb FROM rows""")
def paragraph_lines(spark, sf_dir):
    rows = once(edited_rows(spark, sf_dir), "compared")
    return layout.line_parts(rows, compare.compare_table_rows(rows)).select("pair_id", "row_no", "kind", "act", "la", "lb")


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey * 8 + l_linenumber AS pos, l_orderkey, l_linenumber FROM lineitem),
  j AS (SELECT *, (l_linenumber % 3)::INT AS level, CASE WHEN l_orderkey % 11 = 0 THEN 'o' || (l_orderkey % 3) END AS ov FROM i),
  n AS (SELECT *, (ov IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, ov ORDER BY pos) = 1)::INT AS fresh FROM j),
  e AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS epoch FROM n),
  g AS (SELECT *, sum((level < 1)::INT) OVER w AS g1, sum((level < 2)::INT) OVER w AS g2, sum((level = 0)::INT) OVER w AS c0 FROM e WINDOW w AS (PARTITION BY doc_id, epoch ORDER BY pos)),
  c AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id, epoch, g1 ORDER BY pos) AS c1, sum((level = 2)::INT) OVER (PARTITION BY doc_id, epoch, g2 ORDER BY pos) AS c2 FROM g)
  SELECT doc_id, pos, CASE level WHEN 0 THEN (c0 + 4) || '.' WHEN 1 THEN (CASE WHEN c0 > 0 THEN c0 + 4 ELSE 5 END) || '-' || c1 || ')'
    ELSE repeat(chr((97 + (c2 - 1) % 26)::INT), ((c2 - 1) // 26 + 1)::INT) || '.' END AS label FROM c""")
def nested_list_labels(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("level")).distinct()
    override = F.when(F.col("l_orderkey") % 11 == 0, F.concat(F.lit("o"), (F.col("l_orderkey") % 3).cast("string")))
    starts, formats = F.create_map(F.lit(0), F.lit(5)), F.create_map(F.lit(1), F.lit("decimal"), F.lit(2), F.lit("lowerLetter"))
    items = items.select("doc_id", "pos", F.lit(True).alias("ordered"), "level", F.lit("k").alias("key"), override.alias("override"), F.when(F.col("level") == 1, "%1-%2)").alias("template"), starts.alias("starts"), formats.alias("formats"))
    return layout.list_labels(items, levels=3).select("doc_id", "pos", "label")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['•', '◦', '▪'][p_partkey % 4 % 3 + 1] WHEN 1 THEN '◆' WHEN 2 THEN ['•', '◦', '▪'][p_partkey % 4 % 3 + 1] WHEN 3 THEN '→' WHEN 4 THEN '◦'
  ELSE ['•', '◦', '▪'][p_partkey % 4 % 3 + 1] END AS label FROM part""")
def bullets(spark, sf_dir):
    k = F.col("p_partkey")
    template = F.element_at(F.array(F.lit(""), F.lit("\uf0a8"), F.lit("\ue123"), F.lit("→"), F.lit("o"), F.lit("%1.")), (k % 6 + 1).cast("int"))
    empty = F.create_map().cast("map<int,int>")
    items = table(spark, sf_dir, "part").select("p_partkey", k.alias("doc_id"), k.alias("pos"), F.lit(False).alias("ordered"), (k % 4).cast("int").alias("level"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("override"), template.alias("template"), empty.alias("starts"), empty.cast("map<int,string>").alias("formats"))
    return layout.list_labels(items, levels=1).select("p_partkey", "label")


@query("""WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS k, l_linenumber AS n, (l_quantity % 40)::DOUBLE AS ha, (l_partkey % 30)::DOUBLE AS hb FROM lineitem
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity),
  o AS (SELECT *, coalesce(sum(ha) OVER w, 0) AS ta, coalesce(sum(hb) OVER w, 0) AS tb, coalesce(sum(greatest(ha, hb)) OVER w, 0) AS v, greatest(ha, hb) AS tall
    FROM l WINDOW w AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  z AS (SELECT k, max(v + tall) AS total, sum(ha) AS len_a, sum(hb) AS len_b FROM o GROUP BY k),
  s AS (SELECT *, (i * 15)::DOUBLE AS s, 50::DOUBLE AS h, 60::DOUBLE AS m FROM z, range(0, 5) r(i)),
  p AS (SELECT *, least(1, greatest(0, 0.5 * least(1, greatest(0, s / 25)) + 0.5 * least(1, greatest(0, (s - 35) / 25)))) AS point FROM s),
  y AS (SELECT *, least(greatest(s + point * h, 0), total) AS y FROM p),
  f AS (SELECT y.*, (SELECT max(n) FROM o WHERE o.k = y.k AND o.v <= y.y) AS line FROM y),
  t AS (SELECT f.*, o.ta, o.tb, o.ha, o.hb, CASE WHEN tall > 0 THEN least(1, greatest(0, (y - v) / tall)) ELSE 0 END AS t FROM f JOIN o ON o.k = f.k AND o.n = f.line)
  SELECT k AS l_orderkey, i AS scroll_id, line::INT AS line, round(y, 6) AS y, round(t, 6) AS t,
    round(least(greatest(least(greatest(y - (ta + t * ha), least(s + h, total) - len_a), s), 0), greatest(0, total - len_a)), 6) AS a,
    round(least(greatest(least(greatest(y - (tb + t * hb), least(s + h, total) - len_b), s), 0), greatest(0, total - len_b)), 6) AS b FROM t""")
def column_offsets(spark, sf_dir):
    one = F.min_by(F.struct((F.col("l_quantity") % 40).cast("double").alias("ha"), (F.col("l_partkey") % 30).cast("double").alias("hb")), F.struct("l_partkey", "l_quantity")).alias("x")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("line_no")).agg(one)
    above = lambda c: F.expr(f"coalesce(sum(x.{c}) OVER (PARTITION BY pair_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D)")
    lines = lines.select("pair_id", "line_no", above("ha").alias("top_a"), above("hb").alias("top_b"), F.col("x.ha").alias("height_a"), F.col("x.hb").alias("height_b"))
    scrolls = lines.select("pair_id").distinct().select("pair_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("scroll_id"))
    scrolls = scrolls.select("pair_id", "scroll_id", (F.col("scroll_id") * 15).cast("double").alias("s"), F.lit(50.0).alias("h"), F.lit(60.0).alias("s_max"))
    r = layout.column_offsets(lines, scrolls)
    return r.select(F.col("pair_id").alias("l_orderkey"), "scroll_id", "line", *[F.round(c, 6).alias(c) for c in ("y", "t", "a", "b")])


# ------------------------------------------------------------------ undo and sessions


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'undo' WHEN event_id % 5 = 0 THEN 'redo' ELSE 'commit' END AS action,
    event_type AS label, 'd' || event_id AS docs, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  s AS (SELECT session, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS now, NULL::VARCHAR AS done, []::STRUCT(d VARCHAR, l VARCHAR)[] AS past, []::STRUCT(d VARCHAR, l VARCHAR)[] AS future
      FROM (SELECT DISTINCT session FROM e)
    UNION ALL SELECT s.session, e.n, e.seq,
      CASE WHEN action = 'commit' THEN docs WHEN action = 'undo' AND len(past) > 0 THEN past[-1].d WHEN action = 'redo' AND len(future) > 0 THEN future[-1].d ELSE now END,
      CASE WHEN action = 'commit' THEN label WHEN action = 'undo' AND len(past) > 0 THEN past[-1].l WHEN action = 'redo' AND len(future) > 0 THEN future[-1].l END,
      CASE WHEN action = 'commit' THEN list_append(past, {'d': now, 'l': label}) WHEN action = 'undo' THEN past[:-2] WHEN len(future) > 0 THEN list_append(past, {'d': now, 'l': future[-1].l}) ELSE past END,
      CASE WHEN action = 'commit' THEN [] WHEN action = 'redo' THEN future[:-2] WHEN len(past) > 0 THEN list_append(future, {'d': now, 'l': past[-1].l}) ELSE future END
    FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1)
  SELECT session, seq, now, done, len(past) > 0 AS can_undo, len(future) > 0 AS can_redo FROM s WHERE n > 0""")
def undo_history(spark, sf_dir):
    e = F.col("event_id")
    action = F.when(e % 3 == 0, "undo").when(e % 5 == 0, "redo").otherwise("commit")
    return layout.replayed(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), e.alias("seq"), action.alias("action"), F.col("event_type").alias("label"), F.concat(F.lit("d"), e.cast("string")).alias("docs")))


def _saves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "compare").otherwise("start").alias("scope"), F.col("user_id").cast("string").alias("tab"), F.col("event_id").alias("saved_at"))


_KEPT = "SELECT CASE user_id % 2 WHEN 0 THEN 'compare' ELSE 'start' END AS scope, user_id::VARCHAR AS tab, max(event_id) AS saved_at FROM events GROUP BY user_id ORDER BY saved_at DESC, scope, tab LIMIT 8"


@query(f"SELECT * FROM ({_KEPT})")
def sessions_kept(spark, sf_dir):
    return layout.kept_sessions(_saves(spark, sf_dir))


@query(f"""WITH k AS ({_KEPT}), asked AS (SELECT DISTINCT CASE user_id % 2 WHEN 0 THEN 'compare' ELSE 'start' END AS scope, user_id::VARCHAR AS tab FROM events)
  SELECT a.scope, a.tab, coalesce(k.tab, CASE WHEN a.scope = 'compare' THEN (SELECT arg_max(tab, saved_at) FROM k WHERE scope = 'compare') END) AS from_tab
  FROM asked a LEFT JOIN k ON k.scope = a.scope AND k.tab = a.tab""")
def sessions_restored(spark, sf_dir):
    saves = _saves(spark, sf_dir)
    return layout.restored_sessions(saves.select("scope", "tab").distinct(), layout.kept_sessions(saves))


# ------------------------------------------------------------------ wording, spelling, batches


_FILES = ["a.b.DOCX", "report.pdf", "x.epub", "noext", ".md", "data.TSV", "x.odd", "e.yaml", "Pasted text", "f.txt"]
_KINDS = ["docx", "html", "text", "pdf", "sample", "csv"]


@query(f"""WITH p AS (SELECT p_partkey AS k, {_FILES}[p_partkey % 10 + 1] AS name, {_KINDS}[p_partkey % 6 + 1] AS kind FROM part),
  x AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext FROM p),
  f AS (SELECT *, CASE ext WHEN '' THEN NULL WHEN 'docx' THEN 'Word document' WHEN 'pdf' THEN 'PDF' WHEN 'epub' THEN 'EPUB book' WHEN 'md' THEN 'Markdown file' WHEN 'tsv' THEN 'CSV file' WHEN 'yaml' THEN 'YAML file'
    WHEN 'txt' THEN 'text file' ELSE '.' || ext || ' file' END AS format FROM x)
  SELECT k AS p_partkey, format(E'{{:,}}', k * 7) || CASE WHEN k * 7 = 1 THEN ' change' ELSE ' changes' END AS counted, (k % 3)::VARCHAR || CASE WHEN k % 3 = 1 THEN ' child' ELSE ' children' END AS few,
    CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and c' END AS listed, format AS format,
    CASE WHEN regexp_matches(format, '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || format AS named,
    CASE WHEN kind IN ('html', 'text') AND starts_with(name, 'Pasted') THEN 'Pasted' ELSE ['Word', 'HTML', 'Text', 'PDF', 'Sample', 'CSV'][k % 6 + 1] END AS badge,
    coalesce(nullif(trim(regexp_replace(name, '(?i)[.][a-z0-9]{{1,8}}$', '')), ''), 'document') AS base FROM f""")
def wording(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick(_FILES, 10).alias("name"), pick(_KINDS, 6).alias("kind"))
    items = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 4).cast("int"))
    fmt = words.file_format(F.col("name"))
    return p.select(
        "p_partkey", words.plural(k * 7, "change").alias("counted"), words.plural(k % 3, "child", "children").alias("few"), words.list_text(items).alias("listed"), fmt.alias("format"),
        words.with_article(fmt).alias("named"), words.kind_label(F.col("kind"), F.col("name"), F.lit("")).alias("badge"), words.base_name(F.col("name")).alias("base"),
    )


@query("""WITH RECURSIVE l AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos, length(unnest(string_split(text, chr(10)))) AS n FROM documents),
  b AS (SELECT doc_id, pos, least(n, 6000)::BIGINT AS total, 1 AS items, 0 AS batch FROM l WHERE pos = 0
    UNION ALL SELECT l.doc_id, l.pos, CASE WHEN b.total + least(l.n, 6000) > 6000 OR b.items >= 40 THEN 0 ELSE b.total END + least(l.n, 6000), CASE WHEN b.total + least(l.n, 6000) > 6000 OR b.items >= 40 THEN 0 ELSE b.items END + 1,
      b.batch + (b.total + least(l.n, 6000) > 6000 OR b.items >= 40)::INT FROM b JOIN l ON l.doc_id = b.doc_id AND l.pos = b.pos + 1)
  SELECT doc_id, pos, batch FROM b""")
def check_batches(spark, sf_dir):
    return proof.batched(_lines(spark, sf_dir))


_ADDRESS_SQL = r"(?i)\b(?:https?://|www\.)\S+|\b[\pL\p{M}\p{N}_.+-]+@[\pL\p{M}\p{N}_-]+\.[\pL\p{M}\p{N}_.-]+"
_WORD_SQL = r"[\p{L}\p{M}](?:[\p{L}\p{M}''’-]*[\p{L}\p{M}])?"


def _run(text: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace({text}, '{_ADDRESS_SQL}', ' ', 'g'), '(?:[0-9]|{_WORD_SQL})+'), lambda w: NOT regexp_matches(w, '[0-9]'))"


#: A word of five texts or more is taken for right.
_KNOWN_IN = 5


@query(rf"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+'), lambda w: lower(w)))) AS w FROM documents),
  known AS (SELECT w FROM t GROUP BY w HAVING count(*) >= {_KNOWN_IN}),
  asked AS (SELECT conv_id AS doc_id, turn AS pos, unnest({_run("text")}) AS word FROM conversations),
  checked AS (SELECT *, lower(replace(word, '’', '''')) AS plain FROM asked WHERE length(word) > 1 AND word <> upper(word) AND (substr(word, 2) = lower(substr(word, 2)) OR substr(word, 2) = upper(substr(word, 2)))),
  parts AS (SELECT *, list_filter(string_split(plain, '-'), lambda p: length(p) > 1) AS ps FROM checked)
  SELECT doc_id, pos, word, count(*) AS n FROM parts p WHERE plain NOT IN (FROM known) AND regexp_replace(plain, '''s$', '') NOT IN (FROM known)
    AND NOT (contains(plain, '-') AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(p.ps) AS x) WHERE x NOT IN (FROM known))) GROUP BY ALL""")
def spelling_issues(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{M}]+"), F.lit(0)), F.lower))).alias("word"))
    known = found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= _KNOWN_IN).select("word")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return proof.spelling_issues(lines, known).groupBy("doc_id", "pos", "word").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROWS} SELECT pair_id, row_no, l_text AS a, r_text AS b, true AS numbered FROM rows WHERE kind = 'mod'""")
def inline_segments(spark, sf_dir):
    """Segments of every changed line: joined, they are the line on either side; the changed ones are numbered in order."""
    rows = once(edited_rows(spark, sf_dir), "compared")
    segs = changes.inline_segments(rows).join(rows.select("pair_id", F.col("key").alias("row_key"), "row_no"), ["pair_id", "row_key"])
    found = segs.groupBy("pair_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("seg_no", "equal", "change", "a_text", "b_text"))).alias("s"))
    joined = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "")
    changed = F.transform(F.filter("s", lambda x: ~x["equal"]), lambda x: x["change"])
    in_order = (F.size(changed) > 0) & (changed == F.sequence(F.lit(0), F.greatest(F.size(changed) - 1, F.lit(0))))
    alike = F.forall("s", lambda x: ~x["equal"] | (x["a_text"] == x["b_text"]))
    return found.select("pair_id", "row_no", joined("a_text").alias("a"), joined("b_text").alias("b"), (in_order & alike).alias("numbered"))


@query(f"""WITH m AS (SELECT doc_id, text, length(text) // 2 AS mid, substr(text, length(text) // 2 + 1, 12) AS q FROM documents),
  c AS (SELECT doc_id, text, mid, q, right(left(text, mid), 40) AS p, substr(text, mid + length(q) + 1, 40) AS s FROM m WHERE q <> ''),
  h AS (SELECT *, unnest(list_filter(range(length(text)), lambda i: substr(text, i + 1, length(q)) = q)[:{review.MAX_HITS}]) AS i FROM c),
  g AS (SELECT *, coalesce(list_max(list_filter(range(0, length(p) + 1), lambda k: k <= i AND right(left(text, i), k) = right(p, k))), 0)
    + coalesce(list_max(list_filter(range(0, length(s) + 1), lambda k: substr(text, i + length(q) + 1, k) = left(s, k))), 0) - abs(i - (mid + 7)) / (length(text) + 1) AS score FROM h)
  SELECT doc_id, arg_min(i, struct_pack(a := -score, b := i)) AS start FROM g GROUP BY doc_id""")
def repeated_quotes_found(spark, sf_dir):
    """Short quotes, of which a text has many: the one whose surroundings match best."""
    docs = table(spark, sf_dir, "documents")
    at = F.floor(F.length("text") / 2).cast("int")
    target = review.text_target(F.col("text"), at, F.least(at + 12, F.length("text")))
    marks = docs.select(F.col("doc_id").alias("mark_id"), "doc_id", target.alias("t")).filter("t.quote <> ''").select("mark_id", "doc_id", "t.quote", "t.prefix", "t.suffix", (F.col("t.pos") + 7).alias("pos"))
    return review.locate(marks, docs.select("doc_id", F.col("text").alias("stream"))).select("doc_id", "start")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<br[^>]*>', chr(2), 'g') AS h FROM pages),
  s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '</?(?:p|li|ul|nav|div|article|h1|footer|body|html)(?:\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts FROM b),
  t AS (SELECT page_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS t FROM s),
  c AS (SELECT page_id, n, regexp_replace(trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g')), '^[ \x02]+|[ \x02]+$', '', 'g') AS t FROM t),
  u AS (SELECT page_id, n, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, ' *\x02 *', chr(10), 'g'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&amp;?', '&', 'g') AS t FROM c WHERE t <> '')
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, t AS text FROM u""")
def html_texts(spark, sf_dir):
    """The text of every block of the pages with any, in order."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page.html").alias("name"), F.col("html").cast("binary").alias("content"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    found = load.blocks(spread(pages)).filter("error IS NULL AND stream <> ''")
    return found.select(F.col("doc_id").alias("page_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("stream").alias("text"))
