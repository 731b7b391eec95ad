"""Chat formatting by quotation linking (DataFrame operations only).

Quote levels are read from the ">" marks that lines begin with. Adjacent lines of one level form a
passage; what is left of a message without its quotations is its body. Passages and bodies are
normalised to sequences of lower-case words, so that lines may be wrapped anew. A passage links to a
message whose body has its words in a row: whole messages, single lines, parts of sentences alike.

Candidates come by hash: every window of ``WINDOW`` words of a passage (the whole passage, if it is
shorter) is hashed, and so are the windows of bodies, of which only those that are quoted somewhere are
kept. Of its windows, a passage is joined by that which the fewest bodies have, and the words are then
compared in full. A passage links to the latest earlier message of its own conversation, else to the
first of all. Messages then get their body, their parent, and a position in reply order: a reply stands
in the thread of the message it quotes, threads in order of their first message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions.arrays import let
from seamline.llm.ranking import number_by_ranges
from seamline.llm.skew import salted_join
from seamline.session import durable

QUOTED = r"(?:^|\n)[ \t]*>"
#: Possessive, so that a line of any number of marks is matched without recursion.
MARKS = r"^[ \t]*+((?:>[ \t]?+)++)"
#: Verbs that end a line which announces a quotation. Lines that announce in other words stay in the body.
VERBS = r"(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|escreveu|schreef|skrev|napisał)[ \t]*$"
TURNS_PER_BUCKET = 1_000
#: Words of the windows that candidates are joined by.
WINDOW = 6


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def windows(words: Column, width: Column | int) -> Column:
    """Distinct hashes of all runs of ``width`` words; none if there are fewer."""
    k = F.lit(width) if isinstance(width, int) else width
    each = lambda i, w: F.xxhash64(k, F.array_join(F.slice(w, i, k), " "))
    made = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: each(i, w)))
    return F.when(F.size(words) >= k, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def lines_of(text: Column) -> Column:
    """level, content, announces of every line: it ends with a verb of saying and ":", a deeper line follows."""
    raw = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
    plain = F.transform(raw, lambda x: F.struct(level(x).alias("level"), F.btrim(F.regexp_replace(x, MARKS, ""), F.lit(" \t")).alias("content")))

    def announces(x: Column, i: Column, all_lines: Column) -> Column:
        parts = F.split(x["content"], ":", -1)
        says = x["content"].endswith(":") & F.element_at(parts, -2).rlike(VERBS)
        after = F.get(all_lines, i + 1)
        after = F.when(after["content"] == "", F.get(all_lines, i + 2)).otherwise(after)
        return F.coalesce(F.when(says, after["level"] > x["level"]), F.lit(False))

    return let(plain, lambda ls: F.transform(ls, lambda x, i: F.struct(x["level"].alias("level"), x["content"].alias("content"), announces(x, i, ls).alias("announces"))))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``body`` and ``passages`` (number, level, content: a run of adjacent quoted lines).

    Lines without content and lines that announce a quotation end a passage and belong to none.
    """
    quoting = F.col("text").rlike(QUOTED)

    def body(ls: Column) -> Column:
        own = F.filter(ls, lambda x: (x["level"] == 0) & ~x["announces"])
        return F.btrim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), F.lit(" \t\n"))

    def passages(ls: Column) -> Column:
        blank = lambda x: (x["content"] == "") | x["announces"]
        cut = lambda x, i: (i == 0) | blank(x) | (F.get(ls, i - 1)["level"] != x["level"]) | blank(F.get(ls, i - 1))
        starts = F.filter(F.transform(ls, lambda x, i: F.when(cut(x, i), i)), lambda i: i.isNotNull())

        def runs(st: Column) -> Column:
            end = lambda k: F.coalesce(F.get(st, k + 1), F.size(ls))
            made = F.transform(
                st,
                lambda at, k: F.struct(
                    k.alias("number"), F.get(ls, at)["level"].alias("level"), blank(F.get(ls, at)).alias("blank"),
                    F.array_join(F.transform(F.slice(ls, at + 1, end(k) - at), lambda x: x["content"]), "\n").alias("content"),
                ),
            )
            return F.filter(made, lambda p: (p["level"] > 0) & ~p["blank"])

        return let(starts, runs)

    both = let(lines_of(F.col("text")), lambda ls: F.struct(body(ls).alias("body"), passages(ls).alias("passages")))
    out = messages.withColumn("parts", F.when(quoting, both))
    return out.select(*messages.columns, F.coalesce("parts.body", "text").alias("body"), F.col("parts.passages").alias("passages"))


def containing(passages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``passage``, ``words`` and ``message``, ``body`` → passage, message of every body that has the words in a row."""
    width = F.least(F.size("words"), F.lit(WINDOW))
    grams = durable(passages.select("passage", F.explode(windows(F.col("words"), width)).alias("window")))
    lengths = sorted(r[0] for r in passages.select(width).distinct().collect())
    if not lengths:
        return bodies.select(F.lit("").alias("passage"), "message").where("false")
    spots = bodies.select("message", let(F.split("body", " "), lambda w: F.concat(*[windows(w, k) for k in lengths])).alias("all"))
    spots = spots.select("message", F.explode("all").alias("window")).join(grams.select("window").distinct(), "window", "left_semi")
    spots = durable(spots)
    often = spots.groupBy("window").agg(F.count("*").alias("often"))
    anchors = grams.join(often, "window", "left").groupBy("passage").agg(
        F.min("often").alias("often"), F.min_by("window", F.struct("often", "window")).alias("window"), F.max(F.col("often").isNull()).alias("nowhere")
    )
    anchors = anchors.where(~F.col("nowhere")).select("passage", "window")
    pairs = durable(salted_join(spots, anchors, "window", F.col("message"), spots.count()).select("passage", "message"))
    wanted = passages.select("passage", F.array_join("words", " ").alias("wanted"))
    both = salted_join(pairs, wanted, "passage", F.col("message"), pairs.count()).join(bodies, "message")
    within = F.instr(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "wanted", F.lit(" "))) > 0
    return both.where(within).select("passage", "message")


def latest_before(asked: DataFrame, found: DataFrame) -> DataFrame:
    """conv, passage, at of ``asked`` → with ``near``, the greatest (turn, message) of ``found`` before ``at``.

    Turns are taken in buckets: a running maximum over buckets, and one within each.
    """
    group = ["conv", "passage"]
    rows = asked.select(*group, "at").distinct().withColumn("near", F.lit(None).cast("struct<turn:bigint,message:string>"))
    found = found.groupBy(*group, "at").agg(F.max(F.struct(F.col("at").cast("bigint").alias("turn"), "message")).alias("near"))
    rows = rows.unionByName(found).withColumn("bucket", F.floor(F.col("at") / TURNS_PER_BUCKET))
    order = Window.partitionBy(*group).orderBy("bucket")
    most = rows.groupBy(*group, "bucket").agg(F.max("near").alias("most"))
    most = most.select(*group, "bucket", F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = Window.partitionBy(*group, "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.max("near").over(within)).where("near is null").join(most, [*group, "bucket"])
    return rows.select(*group, "at", F.coalesce("here", "earlier").alias("near"))


def link_quotes(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, n_quoted, n_linked, parent_conv, parent_turn, root_turn, position.

    ``position`` counts from 1 within a conversation. Messages that link within no conversation stand in
    a thread of their own. Null texts are empty bodies; null conversations are one conversation, null
    turns its first. Messages with the same conversation, turn and text are one message, kept as often as
    it occurs and linked alike. Of several sources in one turn, that with the greatest message hash is
    taken. Lines may begin with any number of marks, messages may be of any length; an empty table gives no
    rows. Further columns of ``df`` are not looked at.
    """
    m = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    m = m.withColumn("conv", conv).withColumn("at", F.coalesce("turn", F.lit(-1)))
    m = m.withColumn("message", F.md5(F.concat_ws("\x1f", "conv", F.coalesce(F.col("turn").cast("string"), F.lit("")), "text")))
    once = durable(parsed(m.select("conv_id", "turn", "conv", "at", "message", "text").dropDuplicates(["message"])).drop("text"))

    quotes = once.where(F.size("passages") > 0).select("message", "conv", "at", F.explode("passages").alias("p"))
    quotes = quotes.select("message", "conv", "at", "p.level", "p.number", normalised(F.col("p.content")).alias("words"))
    quotes = durable(quotes.select("*", F.md5("words").alias("passage")))
    passages = quotes.select("passage", F.split("words", " ").alias("words")).where("words[0] <> ''").dropDuplicates(["passage"])
    bodies = once.select("message", normalised(F.col("body")).alias("body"))
    found = containing(passages, bodies).join(once.select("message", "conv_id", "turn", "conv", "at"), "message")
    found = durable(found)

    near = latest_before(quotes, found.join(quotes.select("conv", "passage").distinct(), ["conv", "passage"], "left_semi"))
    first = found.groupBy("passage").agg(F.min(F.struct("conv_id", "turn", "message")).alias("first"))
    linked = salted_join(quotes.join(near, ["conv", "passage", "at"], "left"), first, "passage", F.col("message"), quotes.count(), "left")
    far = F.when(F.col("first.message") != F.col("message"), F.col("first.message"))
    parent = F.coalesce("near.message", far)
    ranked = F.struct(F.col("near").isNull().alias("far"), "level", "number", parent.alias("parent"))
    links = linked.groupBy("message").agg(
        F.count("*").alias("n_quoted"), F.count(parent).alias("n_linked"), F.min(F.when(parent.isNotNull(), ranked)).alias("best")
    )
    places = once.select(F.col("message").alias("parent"), F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"))
    links = durable(links.select("message", "n_quoted", "n_linked", F.col("best.parent").alias("parent")))
    links = durable(salted_join(links, places, "parent", F.col("message"), links.count(), "left"))

    roots = thread_roots(links.join(once.select("message", "conv_id", "turn"), "message"))
    copies = m.groupBy("conv_id", "turn", "role", "message").agg(F.count("*").alias("copies"))
    out = copies.join(once.select("message", "body"), "message").join(links.drop("parent"), "message", "left").join(roots, "message", "left")
    out = out.select(
        "conv_id", "turn", "role", "body",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_conv", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), "message", "copies",
    )
    out = number_by_ranges(out, ["conv_id"], ["root_turn", "turn", "role", "message"], "copies", "first_position")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    out = out.select("*", copy).withColumn("position", F.col("first_position") + F.col("copy"))
    return out.drop("message", "copies", "first_position", "copy")


def thread_roots(links: DataFrame) -> DataFrame:
    """message, root_turn of messages whose parent is earlier in their conversation, by pointer doubling."""
    own = F.col("parent_conv").eqNullSafe(F.col("conv_id")) & (F.coalesce("parent_turn", F.lit(-1)) < F.coalesce("turn", F.lit(-1)))
    up = durable(links.where(own).select("message", F.col("parent").alias("root"), F.col("parent_turn").alias("root_turn")))
    rows = up.count()
    while True:
        above = up.select(F.col("message").alias("root"), F.col("root").alias("next"), F.col("root_turn").alias("next_turn"))
        known = F.col("next").isNotNull()
        moved = salted_join(up, above, "root", F.col("message"), rows, "left").select(
            "message", F.coalesce("next", "root").alias("root"), F.when(known, F.col("next_turn")).otherwise(F.col("root_turn")).alias("root_turn"), known.alias("moved")
        )
        moved = durable(moved)
        if moved.where("moved").isEmpty():
            return up.select("message", "root_turn")
        up = moved.drop("moved")


def op7_quote_links(spark, sf_dir: str) -> DataFrame:
    """Every message of the conversations, without quotes, in reply order."""
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
