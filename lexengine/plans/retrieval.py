"""Registered queries of forgiving search, full text, joins by time, chains and order statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexengine.operators import closure, fulltext, fuzzy, increment, orderstats, temporal
from lexengine.plans import adapters
from lexengine.plans.adapters import table
from lexengine.plans.registered import query
from lexengine.session import scratch_dir
from lexengine.sources import cmudict

# --- forgiving search (X24) ---------------------------------------------------------------------


def _part_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key"))


def _document_words(spark: SparkSession, d: str) -> DataFrame:
    """The runs of plain letters in documents, as often as they occur."""
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("query"))


_TYPO = """
q AS (SELECT w AS query, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w),
w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
m AS (SELECT query, n, word, levenshtein(query, word) AS distance FROM q JOIN w ON abs(length(query) - length(word)) <= 2 AND levenshtein(query, word) <= 2)"""


@query(f"WITH {_TYPO} SELECT query, word, CAST(distance AS INTEGER) AS distance FROM m")
def typo_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents with every word of a part's name from which two edits part it at most."""
    return fuzzy.typo_matches(_document_words(spark, d), fuzzy.typo_index(_part_words(spark, d)))


@query(f"""WITH {_TYPO} SELECT * FROM (SELECT word AS query, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, -n, query) AS INTEGER) AS place, query AS word, CAST(distance AS INTEGER) AS distance, -n AS rank FROM m) WHERE place <= 5""")
def typo_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """For each word of a part's name the five nearest words of the documents, the most frequent first."""
    words = _document_words(spark, d).groupBy(F.col("query").alias("key")).agg((-F.count(F.lit(1))).alias("rank"))
    return fuzzy.typo_suggestions(_part_words(spark, d).withColumnRenamed("key", "query"), words)


@query("""WITH p AS (SELECT DISTINCT unnest(['*' || right(s_name, 3), 'Cust*' || right(s_name, 2), '*#*' || right(s_name, 2) || '*', '?ustomer#*' || right(s_name, 1) || '??', '*' || right(s_name, 1) || '?1*']) AS pattern FROM supplier)
SELECT pattern, c_name AS key FROM p JOIN customer ON c_name LIKE replace(replace(pattern, '*', '%'), '?', '_')""")
def wildcard_matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers by patterns with wildcards in front, inside and at the end, made of the names of suppliers."""
    end = lambda n: F.expr(f"right(s_name, {n})")
    made = [F.concat(F.lit("*"), end(3)), F.concat(F.lit("Cust*"), end(2)), F.concat(F.lit("*#*"), end(2), F.lit("*")), F.concat(F.lit("?ustomer#*"), end(1), F.lit("??")), F.concat(F.lit("*"), end(1), F.lit("?1*"))]
    patterns = table(spark, d, "supplier").select(F.explode(F.array(*made)).alias("pattern"))
    return fuzzy.wildcard_matches(patterns, fuzzy.gram_index(table(spark, d, "customer"), "c_name"))


@query("""WITH s AS (SELECT 'w' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS word, CASE p_size % 3 WHEN 0 THEN 'AE T' WHEN 1 THEN 'AO G' ELSE 'OW' END AS rhyme FROM part)
SELECT * FROM (SELECT word, rhyme, count(*) OVER (PARTITION BY rhyme) - 1 AS others FROM s) WHERE others > 0""")
def rhyme_classes(spark: SparkSession, d: str) -> DataFrame:
    """Words of the pronouncing dictionary that rhyme, with the number of others."""
    return fuzzy.rhymes(cmudict.parse(adapters.cmudict_lines(spark, d)).select("word", F.col("pronunciation").alias("phones")))


# Letters as phones, each by its most usual sound.
_SOUNDS = dict(zip("abcdefghijklmnopqrstuvwxyz", "AE B K D EH F G HH IH JH K L M N AA P K R S T AH V W Z Y Z".split(), strict=True))


def _spoken(word: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in _SOUNDS.items() for x in pair]), c)), " ")


_CODE = "array_to_string(list_transform(string_split({0}, ''), lambda c: map_extract(m, c)[1]), '')"


@query(f"""WITH k AS (SELECT MAP {{{", ".join(f"'{c}': '{fuzzy.phone_codes()[p]}'" for c, p in _SOUNDS.items())}}} AS m),
q AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS query FROM part), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
a AS (SELECT query, {_CODE.format("query")} AS x FROM q, k), b AS (SELECT word, {_CODE.format("word")} AS y FROM w, k)
SELECT query, word, CAST(levenshtein(x, y) AS INTEGER) AS cost FROM a JOIN b ON abs(length(x) - length(y)) <= 2 AND levenshtein(x, y) <= 2""")
def sound_alikes(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents that sound like a word of a part's name, with letters read as phones."""
    queries = _part_words(spark, d).select(F.col("key").alias("query")).distinct()
    words = _document_words(spark, d).select(F.col("query").alias("word")).distinct()
    return fuzzy.sound_alikes(queries.withColumn("phones", _spoken(F.col("query"))), words.withColumn("phones", _spoken(F.col("word"))))


# --- full text (X24) ----------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws FROM documents WHERE doc_id IS NOT NULL),
size AS (SELECT doc, len(ws) AS size FROM t), all_docs AS (SELECT count(*) AS n, avg(size) AS mean FROM size),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, all_docs GROUP BY term, n),
q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM benchmark),
scored AS (SELECT query, doc, CAST(sum(CAST(round(idf * (tf * {fulltext.K1 + 1}::DOUBLE / (tf + {fulltext.K1}::DOUBLE * ({1 - fulltext.B}::DOUBLE + {fulltext.B}::DOUBLE * size / mean))), {fulltext.DIGITS}) AS DECIMAL(18,{fulltext.DIGITS}))) AS DOUBLE) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN size USING (doc), all_docs GROUP BY query, doc)
SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place, doc, score FROM scored) WHERE place <= 10""")
def best_texts(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for the words of each benchmark passage."""
    index = fulltext.text_index(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return fulltext.best_texts(index, table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"))


_WRAPPED = "list_aggregate(list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+'), lambda w: ' ' || w || ' '), 'string_agg', '')"


@query(f"""WITH s AS (SELECT item_id, unnest(string_split(text, '.')) AS sentence, generate_subscripts(string_split(text, '.'), 1) - 1 AS nth FROM benchmark),
p AS (SELECT item_id * 1000 + nth AS phrase, {_WRAPPED.format("sentence")} AS words FROM s),
t AS (SELECT doc_id AS doc, {_WRAPPED.format("text")} AS words FROM documents)
SELECT phrase, doc, CAST((length(t.words) - length(replace(t.words, p.words, ''))) / length(p.words) AS BIGINT) AS places FROM p JOIN t ON p.words <> '' AND contains(t.words, p.words)""")
def phrase_places(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold a sentence of a benchmark passage word by word, and at how many places."""
    sentences = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("nth", "text"))
    index = fulltext.positions(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    found = fulltext.phrase_places(index, sentences.select((F.col("item_id") * 1000 + F.col("nth")).alias("phrase"), "text"))
    return found.groupBy("phrase", "doc").agg(F.count(F.lit(1)).alias("places"))


# --- time (J20) ---------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_partkey, l_shipdate, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL)
SELECT o_orderkey, l_orderkey AS last_line FROM orders ASOF LEFT JOIN r ON o_custkey = l_partkey AND o_orderdate >= l_shipdate""")
def as_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the line of the part of its customer's number that was shipped last before it."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("last_line"))
    return temporal.as_of(orders, lines, "k", "at", ["last_line"], ranges=16).select("o_orderkey", "last_line")


@query("""WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT x.l_partkey AS part, x.l_orderkey AS left_order, x.l_linenumber AS left_line, y.l_orderkey AS right_order, y.l_linenumber AS right_line
FROM s x JOIN s y ON x.l_partkey = y.l_partkey AND x.l_returnflag = 'R' AND y.l_returnflag = 'A' AND x.a <= y.b AND y.a <= x.b""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a part that came back and lines that did not, whose days from shipment on, one per piece, overlap."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    spans = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_returnflag", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))
    found = temporal.overlaps(spans.filter("l_returnflag = 'R'"), spans.filter("l_returnflag = 'A'"), "part", "a", "b")
    return found.select("l.part", F.col("l.l_orderkey").alias("left_order"), F.col("l.l_linenumber").alias("left_line"), F.col("r.l_orderkey").alias("right_order"), F.col("r.l_linenumber").alias("right_line"))


# --- chains (U6) --------------------------------------------------------------------------------


_LINKS = """links AS (SELECT o_orderkey AS id, coalesce(lag(o_orderkey) OVER w, CASE WHEN c_acctbal < 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END) AS up
FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
chain AS (SELECT id AS node, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.id, c.root, c.depth + 1, c.path || '>' || l.id FROM links l JOIN chain c ON l.up = c.node)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Orders after the order before of their customer; if the account is overdrawn, the first one comes after the last: a cycle."""
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    last = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    return own.select(F.col("o_orderkey").alias("id"), F.coalesce(before, F.when(F.col("c_acctbal") < 0, last)).alias("parent_id"))


@query(f"""WITH RECURSIVE {_LINKS} SELECT id AS node, root, CAST(depth AS BIGINT) AS depth, root IS NULL AS cyclic, coalesce(path, '') AS path FROM links LEFT JOIN chain ON id = node""")
def order_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the first of its chain, its depth and the way down to it, or that its chain is a cycle."""
    return closure.chains(_links(spark, d)).withColumn("path", F.coalesce(F.array_join(F.transform("path", lambda x: x.cast("string")), ">"), F.lit("")))


@query(f"""WITH RECURSIVE {_LINKS}, up AS (SELECT c.node, l.up AS ancestor, 1 AS distance FROM chain c JOIN links l ON l.id = c.node WHERE l.up IS NOT NULL
  UNION ALL SELECT u.node, l.up, u.distance + 1 FROM up u JOIN links l ON l.id = u.ancestor WHERE l.up IS NOT NULL)
SELECT node, ancestor, CAST(distance AS BIGINT) AS distance FROM up""")
def order_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Each order with every earlier one of its chain."""
    return closure.ancestors(closure.chains(_links(spark, d)))


# --- order statistics (A19) ---------------------------------------------------------------------


_SHARES = (0.25, 0.5, 0.99)


@query(f"""WITH v AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
{" UNION ALL ".join(f"SELECT o_custkey, {q}::DOUBLE AS q, count(*) AS n, quantile_disc(cents, {q}) AS x FROM v GROUP BY o_custkey" for q in _SHARES)}""")
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The quarter, the median and the 99th hundredth of each customer's orders in cents; customers with more than eight are counted bit by bit."""
    cents = table(spark, d, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return orderstats.quantiles(cents, "o_custkey", "cents", list(_SHARES), small=8)


# --- the key table (C28) ------------------------------------------------------------------------


@query("SELECT lower(c_name) AS key, c_custkey AS id, c_mktsegment AS segment FROM customer")
def key_table_inserts(spark: SparkSession, d: str) -> DataFrame:
    """All customers by key, from a table of one market segment into which the others were inserted one by one, with a compaction in between."""
    rows = table(spark, d, "customer").select(F.lower("c_name").alias("key"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    # Market segments are a handful of labels.
    first, *others = [r.segment for r in rows.select("segment").distinct().orderBy("segment").collect()] or [""]
    keys = increment.create(rows.filter(F.col("segment") == first), scratch_dir(spark), 8)
    for number, segment in enumerate(others):
        keys = increment.insert(keys, rows.filter(F.col("segment") == segment))
        keys = increment.compact(spark, keys) if number == 1 else keys
    return increment.lookup(spark, keys)
