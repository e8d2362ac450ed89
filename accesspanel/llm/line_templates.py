"""Line deduplication by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line's leaf is its number of tokens and its (up to DEPTH) leading
tokens, with tokens that hold a digit replaced by ``<*>``. Behind these, a token of a line is a
variable field and becomes ``<*>`` as well, if

* *family*: at least FAMILY different lines of the leaf, this one among them, differ at its place
  only, or
* *rare*: fewer than one in RARE of the leaf's different lines have the token at its place.

At most a quarter of a line's tokens may become fields: if both rules give more, the first alone
decides; if that gives more, the line stays as it is. Both rules look at different lines within a
leaf, so a template is found alike in a hundred rows and in a billion.

Lines alike after that share a template. It recurs if at least ``least_docs`` documents
have it: two for long lines, three for others, and for lines of a few tokens, which recur by chance
in prose, a share of the table. It is then kept in its first document (least ``doc_id``)
and dropped from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import free_name, materialize, row_hash

#: Leading tokens that choose the leaf.
DEPTH = 3
#: Different lines that make a family.
FAMILY = 3
#: A token at its place in fewer than one in RARE of a leaf's lines is a field.
RARE = 3
#: At most one in FIELDS tokens of a line may be a field.
FIELDS = 4
#: Documents that make a template recur.
MIN_DOCS = 3
#: Lines of so many tokens recur from LONG_DOCS documents on.
LONG_TOKENS, LONG_DOCS = 50, 2
#: Lines under so many tokens must be in SHORT_DOCS documents and in one of SHORT_SHARE rows.
SHORT_TOKENS, SHORT_DOCS, SHORT_SHARE = 5, 10, 1000
#: Rows of one key are spread over so many tasks.
SALTS = 16
#: Stands for a missing id, which comes last.
NO_ID = (1 << 63) - 1

SPACES = "\t\x0b\f\r"
ANY = "<*>"


def tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit as ``<*>``. Most lines have neither a digit
    nor white space but blanks, and are split as they are."""
    masked = F.regexp_replace(F.translate(line, SPACES, " " * len(SPACES)), "[^ ]*[0-9][^ ]*", ANY)
    return F.array_remove(F.split(F.when(line.rlike(f"[0-9{SPACES}]"), masked).otherwise(line), " "), "")


def least_docs(size: Column, rows: int) -> Column:
    """Documents in which a template of ``size`` tokens must be, in a table of ``rows`` rows."""
    return (
        F.when(size >= LONG_TOKENS, LONG_DOCS)
        .when(size < SHORT_TOKENS, max(SHORT_DOCS, -(-rows // SHORT_SHARE)))
        .otherwise(MIN_DOCS)
    )


def _different(text: str) -> Column:
    return F.array_distinct(F.split(text, "\n"))


def _lines(docs: DataFrame) -> DataFrame:
    """Different lines of each row that hold a token without a digit, and their leaf."""
    return (
        docs.select("doc", "row", F.posexplode(_different("text")).alias("pos", "raw"))
        .select("*", tokens(F.col("raw")).alias("tokens"))
        .withColumn("size", F.size("tokens"))
        .where(F.size(F.array_remove("tokens", ANY)) > 0)
        .withColumn("leaf", F.xxhash64("size", F.slice("tokens", 1, DEPTH)))
        .withColumn("line", F.xxhash64("tokens"))
    )


def _spread(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Equi-join in which the rows of one key on the left are dealt to SALTS tasks by
    their ``by``, and the few rows of the right are repeated for each. Never a broadcast:
    Spark takes the right as large as before it is repeated, so that one under its limit
    would meet the driver SALTS times over."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return (
        left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
        .join(right.withColumn("salt", salts).hint("merge"), [*on, "salt"], how)
        .drop("salt")
    )


def _templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``line`` and ``template`` (a hash) of the lines that hold a variable field."""
    leaves = lines.where(f"size > {DEPTH}").groupBy("leaf").agg(F.count("*").alias("kinds")).where(f"kinds >= {FAMILY}")
    chosen = _spread(lines.select("leaf", "line", "row", "pos"), leaves, ["leaf"], "line")
    # a line's text is taken from one row that has it, which holds no more of them than lines
    asked = chosen.groupBy("row").agg(F.collect_list(F.struct("leaf", "kinds", "line", "pos")).alias("asked"))
    given = F.transform("asked", lambda a: a.withField("raw", F.get("different", a["pos"])))
    texts = materialize(
        docs.select("row", _different("text").alias("different"))
        .join(asked, "row")
        .select(F.inline(given))
        .dropDuplicates(["line"])
        .drop("pos"),
        "leaf-lines",
    )
    hashed = texts.select("leaf", "kinds", "line", F.transform(tokens(F.col("raw")), lambda t: F.xxhash64(t)).alias("h"))
    # all tokens of a line but one: their hashes, each with its place, xor-ed
    placed = F.transform("h", lambda h, i: F.xxhash64(h, i))
    whole = F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))
    behind = F.slice(F.arrays_zip("h", "placed"), DEPTH + 1, F.size("h"))
    at = (
        hashed.withColumn("placed", placed)
        .withColumn("whole", whole)
        .select("leaf", "kinds", "line", "whole", F.posexplode(behind).alias("place", "x"))
        .select(
            "leaf", "kinds", "line", (F.col("place") + DEPTH).alias("place"), F.col("x.h").alias("h"),
            F.col("whole").bitwiseXOR(F.col("x.placed")).alias("rest"),
        )
    )
    family = ["leaf", "place", "rest"]
    families = at.groupBy(*family).agg(F.count("*").alias("n")).where(f"n >= {FAMILY}").drop("n")
    members = _spread(at.select("line", *family), families, family, "line", "left_semi")
    varied = members.groupBy("line").agg(F.collect_set("place").alias("varied"))
    # at most RARE tokens of a place are not rare
    common = (
        at.where(f"kinds > {RARE}")
        .groupBy("leaf", "place", "h")
        .agg(F.count("*").alias("n"), F.min("kinds").alias("kinds"))
        .groupBy("leaf", "place")
        .agg(F.collect_list(F.when(F.col("n") * RARE >= F.col("kinds"), F.col("h"))).alias("h"))
        .groupBy("leaf")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]).alias("common"))
    )
    masked = F.xxhash64(F.lit(ANY))
    rare = F.filter(
        F.transform("h", lambda h, i: F.when(~F.array_contains(F.get("common", i - DEPTH), h), i)),
        lambda i: i.isNotNull(),
    )
    known = (
        _spread(hashed, common, ["leaf"], "line", "left")
        .join(varied, "line", "left")
        .withColumn("varied", F.coalesce("varied", F.array().cast("array<int>")))
        .withColumn("both", F.array_union("varied", F.coalesce(rare, F.array().cast("array<int>"))))
    )
    # what is masked already takes no room of the fields
    room = lambda c: F.size(F.filter(c, lambda i: F.get("h", i) != masked)) * FIELDS <= F.size("h")
    fields = F.when(room("both"), F.col("both")).when(room("varied"), F.col("varied"))
    general = F.transform("h", lambda h, i: F.when(F.array_contains("fields", i), masked).otherwise(h))
    return (
        known.withColumn("fields", fields)
        # a masked token stands for a field of other lines
        .where((F.coalesce(F.size("fields"), F.lit(0)) > 0) | F.array_contains("h", masked))
        .select("line", F.xxhash64("leaf", general).alias("template"))
    )


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and any others) with recurring template
    lines taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    A NULL text stays NULL with no lines; an empty one is one empty line. Rows of
    one ``doc_id`` are one document, repeated rows too: they lose nothing to each other, and a
    template counts once for them. Rows without an id are one document, the last. Lines of which
    no token is without a digit stay. A row whose every line goes has an empty text. Columns of ``docs`` named like the
    two counts give way to them. No rows: none."""
    rows = docs.count()
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    plain = docs.select(doc.alias("doc"), row_hash().alias("row"), F.col("text").cast("string").alias("text"))
    narrow = materialize(
        _lines(plain)
        .groupBy("doc", "leaf", "line", "size")
        .agg(F.min("row").alias("row"), F.min_by("pos", "row").alias("pos")),
        "lines",
    )
    lines = materialize(
        narrow.groupBy("leaf", "line", "size").agg(
            F.count("*").alias("n"),
            F.min("doc").alias("first"),
            F.min("row").alias("row"),
            F.min_by("pos", "row").alias("pos"),
        ),
        "distinct-lines",
    )
    templates = materialize(_templates(plain, lines), "templates")
    # a document counts once for a template, however many of its lines have it
    general = (
        _spread(narrow.select("doc", "line", "size"), templates, ["line"], "doc")
        .groupBy("template", "size", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("template", "size")
        .agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") >= least_docs(F.col("size"), rows))
        .select("template", "first")
    )
    # nor a broadcast here: files of templates are several times smaller than their rows
    literal = (
        lines.where(F.col("n") >= least_docs(F.col("size"), rows))
        .join(templates.hint("merge"), "line", "left_anti")
        .select("line", "first")
    )
    goes = materialize(
        _spread(templates, general, ["template"], "line").select("line", "first").unionByName(literal), "recurring"
    )
    key, gone, kept = (free_name(docs, n) for n in ("drop_id", "drop_lines", "lines_left"))
    drops = (
        _spread(narrow.select("doc", "line"), goes, ["line"], "doc")
        .where("doc != first")
        .groupBy(F.col("doc").alias(key))
        .agg(F.collect_set("line").alias(gone))
    )
    split = F.split(F.col("text").cast("string"), "\n")
    left = F.filter(split, lambda x: ~F.array_contains(gone, F.xxhash64(tokens(x))))
    joined = docs.join(drops, doc == F.col(key), "left")
    changed = F.col(key).isNotNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split))
    n_dropped = F.when(changed & F.col("text").isNotNull(), n_lines - F.size(kept)).otherwise(0)
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text").cast("string"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.withColumn(kept, F.when(changed, left)).select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in others],
        n_lines.cast("bigint").alias("n_lines"),
        n_dropped.cast("bigint").alias("n_dropped"),
    )


#: The rules above in SQL, over whole lists of tokens instead of hashes.
ORACLE_SQL = f"""
WITH raw_lines AS (
  SELECT doc_id, x.line, x.pos, list_filter(regexp_split_to_array(regexp_replace(x.line,
    '[^ \\t\\x0B\\f\\r]*[0-9][^ \\t\\x0B\\f\\r]*', '{ANY}', 'g'), '[ \\t\\x0B\\f\\r]+'), lambda t: t <> '') AS tokens
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS x(line, pos)
), lines AS (
  SELECT DISTINCT doc_id, tokens, [len(tokens)::VARCHAR] || tokens[1:{DEPTH}] AS leaf
  FROM raw_lines WHERE len(list_filter(tokens, lambda t: t <> '{ANY}')) > 0
), kinds AS (
  SELECT leaf, tokens, count(*) OVER (PARTITION BY leaf) AS in_leaf FROM (SELECT DISTINCT leaf, tokens FROM lines)
), places AS (
  SELECT leaf, tokens, in_leaf, unnest(range({DEPTH}, len(tokens))) AS place FROM kinds WHERE in_leaf >= {FAMILY}
), judged AS (
  SELECT tokens, place, tokens[place + 1] <> '{ANY}' AS takes_room,
    count(*) OVER (PARTITION BY leaf, place, tokens[:place], tokens[place + 2:]) >= {FAMILY} AS varied,
    {RARE} * count(*) OVER (PARTITION BY leaf, place, tokens[place + 1]) < in_leaf AS rare
  FROM places
), fields AS (
  SELECT tokens, coalesce(list(place) FILTER (WHERE varied), []) AS varied,
    coalesce(list(place) FILTER (WHERE varied OR rare), []) AS either,
    count(*) FILTER (WHERE varied AND takes_room) AS n_varied,
    count(*) FILTER (WHERE (varied OR rare) AND takes_room) AS n_either
  FROM judged GROUP BY tokens
), named AS (
  SELECT l.doc_id, l.tokens, list_transform(range(len(l.tokens)), lambda i: CASE
      WHEN list_contains(CASE WHEN n_either * {FIELDS} <= len(l.tokens) THEN either
        WHEN n_varied * {FIELDS} <= len(l.tokens) THEN varied END, i)
      THEN '{ANY}' ELSE l.tokens[i + 1] END) AS template
  FROM lines l LEFT JOIN fields f ON f.tokens = l.tokens
), recurring AS (
  SELECT template, min(doc_id) AS first_id FROM named GROUP BY template
  HAVING count(DISTINCT doc_id) >= CASE WHEN len(template) >= {LONG_TOKENS} THEN {LONG_DOCS}
    WHEN len(template) < {SHORT_TOKENS} THEN greatest({SHORT_DOCS}, ceil((SELECT count(*) FROM documents) / {SHORT_SHARE}.0))
    ELSE {MIN_DOCS} END
), gone AS (
  SELECT n.doc_id, n.tokens FROM named n JOIN recurring r ON r.template = n.template WHERE n.doc_id <> r.first_id
)
SELECT n.doc_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.doc_id IS NULL), '') AS text,
  count(*) AS n_lines, count(g.doc_id) AS n_dropped
FROM raw_lines n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.tokens = n.tokens
GROUP BY n.doc_id
"""
