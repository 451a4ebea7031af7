"""Views over the driver tables that give the operators rows; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()

#: Whole tables and whole texts. WORDS(text) stands for a row per word of a text, see ``_words``.
VIEWS = {
    # A cue grows by thirds of its turn's text; the last holds it whole.
    "v_cues": """SELECT c.conv_id AS item_id, c.turn*3+v.k AS pos, c.turn*6.0+v.k AS start_s, c.turn*6.0+v.k+0.8 AS end_s,
 substring(c.text,1,CAST(floor((length(c.text)*(v.k+1)+2)/3) AS INT)) AS text, c.role AS style
 FROM conversations c CROSS JOIN (VALUES (0),(1),(2)) v(k)""",
    "v_frame_obs": """SELECT c.conv_id AS item_id, c.turn*4+v.k AS frame_idx, (c.turn*4+v.k)*0.5 AS t_s,
 CASE WHEN v.k=3 THEN '' ELSE substring(c.text,1,CAST(floor((length(c.text)*(v.k+1)+2)/3) AS INT)) END AS text
 FROM conversations c CROSS JOIN (VALUES (0),(1),(2),(3)) v(k)""",
    # The same with corner brackets, which the tables lack: a quotation opens in one cue and closes in the next.
    "v_quoted": """SELECT c.conv_id AS item_id, c.turn*2+v.k AS pos, c.turn*1.0+v.k*0.5 AS start_s, c.turn*1.0+v.k*0.5+0.5 AS end_s,
 CASE WHEN v.k=0 THEN concat('「', c.text) WHEN c.role='user' THEN concat(c.role, '」') ELSE concat('」', c.role, '。') END AS text
 FROM conversations c CROSS JOIN (VALUES (0),(1)) v(k)""",
    "v_texts": """SELECT CAST(floor(doc_id/50) AS BIGINT) AS item_id, doc_id AS pos, text,
 CASE doc_id%5 WHEN 0 THEN text WHEN 1 THEN '[[未译]]' WHEN 2 THEN 'the request was rejected' ELSE NULL END AS tr FROM documents""",
    # Targets are known for the texts that come again.
    "v_memo": """SELECT text AS src, min(concat(lang, ': ', text)) AS dst FROM documents GROUP BY text HAVING count(*) > 1""",
    "v_tokens": """SELECT doc_id, lang, WORDS(text) AS word FROM documents""",
    # Words and terms are the frequent ones of all texts.
    "v_words": """SELECT word FROM v_tokens WHERE length(word) >= 4 GROUP BY word HAVING count(*) >= 50""",
    "v_glossary": """SELECT doc_id%3 AS layer, min(doc_id) AS line_no, word AS term, lang AS replacement FROM v_tokens
 WHERE length(word) >= 3 GROUP BY doc_id%3, word, lang HAVING count(*) >= 40""",
    "v_sig": """SELECT label AS item_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS frame_idx, embedding AS sig FROM embeddings""",
    "v_loud": """SELECT user_id AS item_id, event_id*0.05 AS t_s, value AS db FROM events""",
    "v_masks": """SELECT o_custkey AS item_id, (o_orderkey%60)*1.0 AS start_s, (o_orderkey%60)*1.0+1+o_orderkey%7 AS end_s,
 (o_orderkey*7)%560 AS x, (o_custkey*5)%300 AS y, 240+o_orderkey%40 AS w, 20+o_custkey%40 AS h,
 CASE o_orderkey%5 WHEN 0 THEN 'mute' WHEN 1 THEN 'cut' WHEN 2 THEN 'blur:20' ELSE 'color:000000' END AS effect,
 CASE WHEN o_orderkey%5=0 THEN 0.5 ELSE 1.0 END AS vol FROM orders""",
    "v_boxes": """SELECT l_suppkey AS item_id, l_orderkey%40 AS frame_idx, l_orderkey*10+l_linenumber AS box_id,
 (l_partkey%20)*20 AS x, (l_partkey%7)*30 AS y, 60 AS w, 60 AS h FROM lineitem""",
    "v_formats": """SELECT l_orderkey AS video_id, l_linenumber AS format_no, CASE l_linenumber%4 WHEN 0 THEN 240 WHEN 1 THEN 360 WHEN 2 THEN 480 ELSE 720 END AS height,
 l_returnflag='R' AS lowest, CASE WHEN l_linestatus='O' THEN NULL ELSE l_extendedprice END AS filesize, l_quantity AS tbr, 60+l_orderkey%60 AS duration FROM lineitem""",
    "v_usage": """SELECT o_orderdate AS ts, o_orderpriority AS endpoint, o_orderkey AS call_id, 100+o_custkey%900 AS prompt_tokens, o_custkey%300 AS completion_tokens, o_custkey%100 AS cached_tokens FROM orders""",
    "v_log": """SELECT ts, event_id, user_id AS item_id, event_type AS stage, props AS payload FROM events""",
    # Pages as answers of a service: some behind a block page, some that speak of a quota or of censorship.
    "v_pages": """SELECT page_id, url, html AS page, CASE page_id%9 WHEN 0 THEN 502 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN 401 WHEN 5 THEN 404 ELSE 200 END AS code,
 CASE page_id%11 WHEN 0 THEN concat('<html><title>Access denied</title>', html) WHEN 1 THEN concat('{"error": "You exceeded your quota"}', url) WHEN 2 THEN concat('CONTENT_FILTER ', url)
 WHEN 3 THEN concat('a wafer biscuit and a captcha ', html) WHEN 4 THEN concat('Just a Moment... ', html) ELSE html END AS body FROM pages""",
    "v_times": """SELECT DISTINCT user_id AS item_id, (event_id%60)*1.0 AS t_s FROM events""",
}
#: Columns that the two engines type as decimals, made doubles for the operators.
DOUBLES = ("start_s", "end_s", "t_s", "vol", "db", "filesize", "tbr")


def _words(sql: str, exploded: str) -> str:
    """WORDS(text) in the words of an engine; words are parted by single blanks."""
    return re.sub(r"WORDS\((\w+)\)", exploded, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for v in VIEWS:
        if v != name and re.search(rf"\b{v}\b", VIEWS[name]):
            view(spark, sf_dir, v).createOrReplaceTempView(v)
    for t in TABLES:
        if re.search(rf"\b{t}\b", VIEWS[name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    df = spark.sql(_words(VIEWS[name], r"explode(split(\1, ' '))"))
    return df.withColumns({c: df[c].cast("double") for c in DOUBLES if c in df.columns})


def _doubled(sql: str) -> str:
    """The view with its decimals as doubles, as the operators get them."""
    found = [c for c in DOUBLES if re.search(rf"\bAS {c}\b", sql)]
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in found)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if found else sql


def with_views(sql: str) -> str:
    """The SQL behind definitions of the views that it names."""
    asked = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    asked |= {v for v in VIEWS for n in asked if re.search(rf"\b{v}\b", VIEWS[n])}
    names = [v for v in VIEWS if v in asked]
    # Views that several parts of a query read are computed once.
    head = ", ".join(f"{v} AS MATERIALIZED ({_words(_doubled(VIEWS[v]), r'unnest(string_split(' + chr(92) + r'1, chr(32)))')})" for v in names)
    own = sql.strip()
    if not names:
        return own
    if own[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {own[15:]}"
    return f"WITH {head}, {own[5:]}" if own[:5].upper() == "WITH " else f"WITH {head} {own}"
