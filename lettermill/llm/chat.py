"""Chat formatting by multi-party perspective rotation (DataFrame functions only).

Every participant of a dialogue gets one rendering in which its own turns are the assistant's and
all others are named users; the mask marks what is trained on: that participant's turns.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch

#: Roles that speak but are no participants: their turns are context in every rendering.
CONTEXT_ROLES = ("system",)
#: Turns of one record. The rendering of a longer dialogue is cut into pieces, so that no record grows without bound.
TURNS_PER_RECORD = 4096
#: Pieces of one turn number at most: pieces are numbered by turn, then by place among the turns of that number.
MOST_PIECES = 1 << 20
#: Most bytes of speakers of the dialogues of several pieces that may be broadcast; beyond it, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _plain(text: Column) -> Column:
    """Text without chat marks of its own: each ``<|`` gets another bar, which a reader can take away again."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _head(role: Column, participant: Column) -> Column:
    return (
        F.when(role.isin(*CONTEXT_ROLES), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role == participant, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _plain(role), F.lit("|>\n")))
    )


def _dealt(crowded: DataFrame, turns_per_record: int, scratch: Scratch) -> DataFrame:
    """``crowded`` (turns of parts that hold too many) with ``piece``, in the order of number, role and text.

    Turns are sorted over all tasks, so a turn's place among those of its number is its place in its task and the count of those
    in tasks before: no task holds a number whole, however many turns have it.
    """
    place = F.coalesce(F.col("t.turn") - F.col("part") * turns_per_record, F.lit(-1)) + F.lit(1)
    rows = crowded.withColumn("number", place).orderBy("conv_id", "part", "t").withColumn("at", F.monotonically_increasing_id())
    rows = scratch.save(rows, "sorted").withColumn("task", F.shiftright("at", 33))
    number = ["conv_id", "part", "number"]
    before = F.sum("n").over(Window.partitionBy(*number).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy(*number, "task").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    runs = runs.withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*number))}).where(F.col("all") > turns_per_record)
    runs = scratch.save(runs.select(*number, "task", "low", "before"), "runs")
    within = F.coalesce(F.floor((F.col("before") + F.col("at") - F.col("low")) / F.lit(turns_per_record)), F.lit(0))
    dealt = rows.join(runs, [*number, "task"], "left").withColumn("piece", (F.col("number") * F.lit(MOST_PIECES) + within).cast("long"))
    return dealt.select("conv_id", "part", "piece", "t", "speakers")


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns_per_record: int = TURNS_PER_RECORD) -> DataFrame:
    """One row per dialogue, piece and participant: ``conv_id, part, piece, participant, n_turns, n_own, text, spans, mask_spans``.

    ``spans`` holds [start, end) code points of ``text`` that the participant's own turns (with their end
    mark) take; ``mask_spans`` is the same as a string ``start-end`` joined by commas.

    - Turns are ordered by turn number, then role, then text (nulls first); repeated rows are repeated turns.
    - A null text is an empty turn; a null role speaks under the empty name and is a participant. ``<|`` in texts and
      names becomes ``<||``, so that they cannot forge a mark.
    - A null conversation: each of its rows is a dialogue of its own. A null turn comes first.
    - A dialogue of context roles only has no participant and so no row. Empty table: no rows.
    - A participant's records of a dialogue in the order of (part, piece) are together its rendering, also where the
      participant is silent. ``part`` is turn div ``turns_per_record``. Where numbers repeat so that a part holds more
      turns than that, each of its numbers has pieces of its own, dealt in the same order; else ``piece`` is 0. So the
      bound never changes the rendering, and no piece holds more turns. Other columns are not used.
    """
    scratch = Scratch(df.sparkSession, "chat")
    role_, text_, turn_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(turn).cast("long")
    rows = df.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.floor(turn_ / F.lit(turns_per_record)), F.lit(0)).cast("long").alias("part"),
        F.lit(0).cast("long").alias("piece"), F.struct(turn_.alias("turn"), role_.alias("role"), text_.alias("text")).alias("t"),
    )
    known = rows.where("conv_id is not null")
    # Dialogues of several pieces: their crowded parts, and who speaks anywhere in them.
    sizes = known.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.collect_set(F.when(~F.col("t.role").isin(*CONTEXT_ROLES), F.col("t.role"))).alias("who"))
    parts = F.collect_list(F.when(F.col("n") > turns_per_record, F.struct("part", "n"))).alias("crowded")
    long = sizes.groupBy("conv_id").agg(parts, F.count("*").alias("parts"), F.array_distinct(F.flatten(F.collect_list("who"))).alias("speakers")).where("parts > 1 or size(crowded) > 0")
    long = scratch.save(long.select(F.col("conv_id").alias("long_id"), F.map_from_entries("crowded").alias("crowded"), "speakers"), "long")
    said = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["role"].isin(*CONTEXT_ROLES)), lambda t: t["role"]))
    turns = F.array_sort(F.collect_list("t")).alias("turns")
    found = long.agg(F.sum(F.octet_length(F.array_join("speakers", " ")) + F.lit(32) + F.lit(16) * F.size("crowded")).alias("bytes"), F.max(F.size("crowded")).alias("crowded")).first()
    if found["bytes"]:
        long = F.broadcast(long) if found["bytes"] <= BROADCAST_BYTES else long
        known = known.join(long, F.col("conv_id") == F.col("long_id"), "left").withColumn("n", F.col("crowded")[F.col("part")])
        if found["crowded"]:
            calm = known.where("n is null").select("conv_id", "part", "piece", "t", "speakers")
            known = calm.unionByName(_dealt(known.where("n is not null").select("conv_id", "part", "t", "speakers"), turns_per_record, scratch))
        dialogues = known.groupBy("conv_id", "part", "piece").agg(turns, F.first("speakers").alias("speakers")).withColumn("speakers", F.coalesce("speakers", said))
    else:
        dialogues = known.groupBy("conv_id", "part", "piece").agg(turns).withColumn("speakers", said)
    single = rows.where("conv_id is null").select("conv_id", "part", "piece", F.array("t").alias("turns")).withColumn("speakers", said)
    dialogues = dialogues.unionByName(single)
    speakers = F.array_sort("speakers")
    each = dialogues.select("conv_id", "part", "piece", "turns", F.explode(speakers).alias("participant"))
    end = F.lit("<|end|>\n")

    def saying(t: Column) -> Column:
        head = _head(t["role"], F.col("participant"))
        return F.struct(F.concat(head, _plain(t["text"]), end).alias("said"), F.length(head).alias("head"), (t["role"] == F.col("participant")).alias("own"))

    each = each.withColumn("said", F.transform("turns", saying))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        after = state["at"] + F.length(p["said"])
        span = F.array(F.struct((state["at"] + p["head"]).alias("start"), (after - F.lit(1)).alias("end")))
        return F.struct(after.alias("at"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("said", start, add, lambda s: s["spans"])
    out = each.select(
        "conv_id", "part", "piece", "participant", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda p: p["said"]), "").alias("text"), spans.alias("spans"),
    )
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.withColumns({"n_own": F.size("spans").cast("long"), "mask_spans": mask})


def op6_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return rotate(turns).select("conv_id", "part", "piece", "participant", "n_turns", "n_own", "text", "mask_spans")


# No dialogue of the tables repeats turn numbers, so that all pieces are 0.
OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rn, conv_id, turn, CAST(coalesce(turn // {TURNS_PER_RECORD}, 0) AS BIGINT) AS part,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT *, CASE WHEN conv_id IS NULL THEN rn END AS own_id FROM t),
p AS (SELECT DISTINCT conv_id, own_id, role AS participant FROM g WHERE role NOT IN (ROLES)),
x AS (
  SELECT p.conv_id, p.own_id, g.part, p.participant, g.turn, g.role, g.text, g.rn,
         CASE WHEN g.role IN (ROLES) THEN '<|' || g.role || '|>' || chr(10)
              WHEN g.role = p.participant THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(g.role, '<|', '<||') || '|>' || chr(10) END AS head
  FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.own_id IS NOT DISTINCT FROM g.own_id),
y AS (SELECT *, head || replace(text, '<|', '<||') || '<|end|>' || chr(10) AS said FROM x),
z AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY conv_id, own_id, part, participant
               ORDER BY turn NULLS FIRST, role, text, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM y)
SELECT conv_id, part, CAST(0 AS BIGINT) AS piece, participant, count(*) AS n_turns, count(*) FILTER (role = participant) AS n_own,
       string_agg(said, '' ORDER BY turn NULLS FIRST, role, text, rn) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(said) - 1 AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text, rn)
         FILTER (role = participant), '') AS mask_spans
FROM z GROUP BY conv_id, own_id, part, participant
""".replace("ROLES", ", ".join(f"'{r}'" for r in CONTEXT_ROLES))
