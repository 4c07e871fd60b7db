"""Token sequences as rows: bans, picks, end cut, vocabulary and decoding to text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafscribe.operators.scale import GROUP_ROWS, lookup, ordinal, same

# Reserved token ids, decode length, batch size and the failure text.
BEGIN, PAD, END = 0, 1, 2
MAX_STEPS = 256
LINES_PER_CALL = 8
FAILED_TEXT = "[error]"

# Token positions that one task holds together.
SPAN = 4096


def trigrams(tokens: DataFrame) -> DataFrame:
    """(a, b, c) for every three neighbours. Positions are dense, so sequences are cut into
    spans that repeat the two tokens at their seams; no window sees more than a span."""
    span = F.floor(F.col("pos") / SPAN)
    spans = F.when((F.col("pos") % SPAN < 2) & (span > 0), F.array(span, span - 1))
    copied = tokens.withColumn("_span", F.explode(F.coalesce(spans, F.array(span))))
    window = Window.partitionBy("seq_id", "_span").orderBy("pos")
    neighbours = copied.select(
        "seq_id",
        "pos",
        F.col("token_id").alias("a"),
        F.lead("token_id", 1).over(window).alias("b"),
        F.lead("token_id", 2).over(window).alias("c"),
    )
    # A repeated token at the end of a span has no third neighbour there: nothing doubles.
    return neighbours.where("c IS NOT NULL")


def banned_next(tokens: DataFrame) -> DataFrame:
    """Token ids that may not come next: the pad id, and every token that already followed
    an earlier copy of the last two tokens. Input (seq_id, pos, token_id)."""
    ends = tokens.groupBy("seq_id").agg(F.max(F.struct("pos", "token_id")).alias("e"))
    ends = ends.select(
        "seq_id", F.col("e.pos").alias("last_pos"), F.col("e.token_id").alias("b")
    )
    before = tokens.select(
        "seq_id", (F.col("pos") + 1).alias("last_pos"), F.col("token_id").alias("a")
    )
    tails = ends.join(before, ["seq_id", "last_pos"]).select("seq_id", "a", "b")
    # Repeated grams shrink before they meet the tail, so a monotonous sequence stays small.
    grams = trigrams(tokens).select("seq_id", "a", "b", "c").distinct()
    repeated = grams.join(tails, ["seq_id", "a", "b"])
    pads = ends.select("seq_id", F.lit(PAD).alias("token_id"))
    return repeated.select("seq_id", F.col("c").alias("token_id")).unionByName(pads).distinct()


def greedy_pick(logits: DataFrame, bans: DataFrame) -> DataFrame:
    """Best-scored token that is not banned, the lowest id on ties."""
    marked = logits.join(bans.withColumn("_banned", F.lit(True)), ["seq_id", "token_id"], "left")
    usable = F.col("_banned").isNull() & ~F.isnan("score") & (F.col("score") > float("-inf"))
    choice = F.struct("score", (-F.col("token_id")).alias("down"))
    best = marked.groupBy("seq_id").agg(F.max(F.when(usable, choice)).alias("m"))
    return best.select(
        "seq_id",
        F.coalesce(-F.col("m.down"), F.lit(BEGIN)).alias("token_id"),
        F.col("m.score").alias("score"),
    )


def eos_cut(tokens: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """Rows before the first end token, at most `steps` of them (the decoder's own limit)."""
    ends = tokens.where(F.col("token_id") == END).groupBy("seq_id").agg(F.min("pos").alias("_end"))
    cut = tokens.where(F.col("pos") < steps).join(ends, "seq_id", "left")
    return cut.where("_end IS NULL OR pos < _end").drop("_end")


def vocab_load(files: DataFrame, column: str = "json") -> DataFrame:
    """(id, token) from vocabulary files; added tokens override."""
    parsed = F.from_json(
        column,
        "struct<model:struct<vocab:map<string,int>>,added_tokens:array<struct<id:int,content:string>>>",
    )
    rows = files.select(parsed.alias("v"))
    base = rows.select(F.explode("v.model.vocab").alias("token", "id")).withColumn("rank", F.lit(0))
    added = rows.select(F.inline("v.added_tokens")).select(
        F.col("content").alias("token"), "id", F.lit(1).alias("rank")
    )
    return vocab_rows(base.unionByName(added))


def vocab_rows(entries: DataFrame) -> DataFrame:
    """One token per id from (id, token, rank); the highest rank wins."""
    return entries.groupBy("id").agg(F.max_by("token", F.struct("rank", "token")).alias("token"))


# The byte alphabet: printable bytes stand for themselves, the others, in byte order, for
# the characters from 256 on. Fixed values are the three printable ranges.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
_HIDDEN = [b for b in range(256) if not any(low <= b <= high for low, high in PRINTABLE)]
# Byte 0 comes first and is treated apart: translate would drop it.
_BYTES = "".join(map(chr, _HIDDEN[1:]))
_SHOWN = "".join(chr(257 + i) for i in range(len(_HIDDEN) - 1))
_OUTSIDE = r"[^\x21-\x7e\xa1-\xac\xae-\xff\x{100}-\x{143}]"
LATIN = "ISO-8859-1"


def to_byte_alphabet(text: Column) -> Column:
    """Text written with one character of the alphabet per UTF-8 byte."""
    raw = F.decode(F.encode(text, "UTF-8"), LATIN)
    return F.replace(F.translate(raw, _BYTES, _SHOWN), F.lit("\0"), F.lit(chr(256)))


def token_bytes(token: Column) -> Column:
    """One Latin-1 character per byte of the token; characters outside the alphabet go."""
    known = F.regexp_replace(token, _OUTSIDE, "")
    return F.replace(F.translate(known, _SHOWN, _BYTES), F.lit(chr(256)), F.lit("\0"))


def token_text(token: Column) -> Column:
    """Text of a single token, with replacement characters where it holds half a character."""
    return F.make_valid_utf8(F.encode(token_bytes(token), LATIN).cast("string"))


def decode_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Text of every token on its own; null for reserved and unknown ids."""
    usable = vocab.where(~F.col("id").isin(BEGIN, PAD, END) & (F.col("token") != ""))
    spelled = usable.select(F.col("id").alias("token_id"), token_text(F.col("token")).alias("text"))
    return lookup(tokens, spelled, ["token_id"])


def detokenise(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Text of each sequence, one row; reserved and unknown ids give nothing.

    Token bytes are looked up once per vocabulary entry. They are joined by spans of SPAN tokens
    first, then the spans of a sequence; the whole is decoded at once, so no seam cuts a character.
    """
    spelled = vocab.select(F.col("id").alias("token_id"), token_bytes(F.col("token")).alias("_raw"))
    kept = tokens.where(~F.col("token_id").isin(BEGIN, PAD, END))
    coded = lookup(kept.select("seq_id", "pos", "token_id"), spelled, ["token_id"])
    part = F.floor(F.col("pos") / SPAN).alias("part")
    packed = coded.groupBy("seq_id", part).agg(
        F.array_sort(F.collect_list(F.struct("pos", "_raw"))).alias("items")
    )
    spans = packed.select(
        "seq_id", "part", F.array_join(F.transform("items", lambda i: i["_raw"]), "").alias("_raw")
    )
    whole = spans.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("part", "_raw"))).alias("items"))
    raw = F.array_join(F.transform("items", lambda i: i["_raw"]), "")
    return whole.select("seq_id", F.make_valid_utf8(F.encode(raw, LATIN).cast("string")).alias("text"))


def decode_timing(lines: DataFrame) -> DataFrame:
    """ms per token and total per line. Input tokens, encoder_ms, decoder_ms."""
    per_token = F.when(F.col("tokens") > 0, F.col("decoder_ms") / F.col("tokens")).otherwise(0.0)
    return lines.withColumns(
        {"ms_per_token": per_token, "total_ms": F.col("encoder_ms") + F.col("decoder_ms")}
    )


def timing_by_worker(lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Summary per worker. The median is exact at any size: the value at the middle position (the lower of two)."""
    timed = decode_timing(lines).select("worker", "tokens", "ms_per_token", "total_ms")
    summary = timed.groupBy("worker").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("tokens").alias("tokens"),
        F.avg("ms_per_token").alias("avg_ms_per_token"),
        F.avg("total_ms").alias("avg_total_ms"),
    )
    known = timed.where("total_ms is not null").select("worker", "total_ms")
    middle = known.groupBy("worker").agg(F.ceil(F.count(F.lit(1)) / 2).alias("_middle"))
    ranked = ordinal(known, ["worker"], ["total_ms"], "_position", limit)
    at = (F.col("_position") == F.col("_middle")) & same(ranked, middle, ["worker"])
    median = ranked.join(middle, at, "left_semi").select(
        F.col("worker").alias("_r_worker"), F.col("total_ms").alias("median_total_ms")
    )
    return summary.join(median, same(summary, median, ["worker"], "_r_"), "left").drop("_r_worker")


READING = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


# Scoring ----------------------------------------------------------------------------------


def score_lines(
    lines: DataFrame,
    make_predict: Callable,
    inputs: list[str],
    shapes: list[list[int]],
    returns: T.DataType | None = None,
    name: str = "result",
) -> DataFrame:
    """Runs a caller's model on at most eight lines per call."""
    returns = returns or T.DoubleType()
    scorer = predict_batch_udf(
        make_predict, return_type=returns, batch_size=LINES_PER_CALL, input_tensor_shapes=shapes
    )
    return lines.withColumn(name, scorer(*[F.col(c) for c in inputs]))


def isolated(make_predict: Callable) -> Callable:
    """A model whose failures stay with their line: where a call fails, its lines are read one by one, and a line that fails alone
    has neither text nor confidence."""

    def make():
        predict = make_predict()

        def attempt(*inputs):
            try:
                return list(predict(*inputs))
            except Exception:  # noqa: BLE001  whatever a model raises
                if len(inputs[0]) == 1:
                    return [{"text": None, "confidence": None}]
                return [attempt(*[x[i : i + 1] for x in inputs])[0] for i in range(len(inputs[0]))]

        return attempt

    return make


def _tensor(column: pa.Array, shape: list[int]) -> np.ndarray:
    """The numbers of all rows in one array; a row of another size is refused."""
    if pa.types.is_list(column.type):
        sizes = pc.fill_null(pc.list_value_length(column), -1)
        if pc.any(pc.not_equal(sizes, math.prod(shape))).as_py():
            raise ValueError("a row does not have the expected shape")
        column = column.flatten()
    # A copy: a model may write into what it gets.
    return np.array(column.to_numpy(zero_copy_only=False)).reshape([-1, *shape])


def read_lines(lines: DataFrame, make_predict: Callable, inputs: list[str], shapes: list[list[int]]) -> DataFrame:
    """Adds the `text` and `confidence` that a caller's model reads, eight lines a call; both are null for lines that it fails on.

    The model returns one dictionary with `text` and `confidence` for each line. Each Python worker makes it once.
    """
    make, name, most, tensor = isolated(make_predict), uuid.uuid4(), LINES_PER_CALL, _tensor

    def read(*columns: pa.Array) -> pa.Array:
        predict = ModelCache.get(name)
        if predict is None:
            predict = make()
            ModelCache.add(name, predict)
        tensors = [tensor(c, shape) for c, shape in zip(columns, shapes, strict=True)]
        found = []
        for at in range(0, len(columns[0]), most):
            some = [t[at : at + most] for t in tensors]
            said = predict(*some)
            if len(said) != len(some[0]):
                raise ValueError("the model did not return one result for each line")
            found += said
        parts = [pa.array([f[c] for f in found], kind, from_pandas=True) for c, kind in (("text", pa.string()), ("confidence", pa.float64()))]
        return pa.StructArray.from_arrays(parts, ["text", "confidence"])

    scored = lines.withColumn("_read", F.arrow_udf(read, READING)(*inputs))
    return scored.withColumns({"text": F.col("_read.text"), "confidence": F.col("_read.confidence")}).drop("_read")


def place_reader(unreadable: int = 77) -> Callable:
    """Stand-in model without weights: reads from a box (x, y, w, h) where its line is, and fails where the rounded
    position ends in the two digits `unreadable`."""

    def make():
        import numpy as np

        def predict(boxes):
            read = []
            for x, y, w, h in boxes.astype("float64"):
                at = int(np.floor(y + 0.5))
                if at % 100 == unreadable:
                    raise ValueError("this line cannot be read")
                read.append({"text": f"line at {at}", "confidence": (x * 0.25 + y * 0.5 + w * 0.75 + h) / 1000})
            return read

        return predict

    return make


def linear_scorer(size: int) -> Callable:
    """Stand-in model: a fixed weighted sum, weights 1..size over size."""

    def make():
        import numpy as np

        weights = (np.arange(size) + 1.0) / size

        def predict(vectors):
            return vectors.astype("float64") @ weights

        return predict

    return make


def error_sentinel(results: DataFrame) -> DataFrame:
    """A failed line (null text) is complete with the failure text and confidence 0."""
    failed = F.col("text").isNull()
    return results.withColumns(
        {
            "text": F.coalesce("text", F.lit(FAILED_TEXT)),
            "confidence": F.when(failed, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))),
            "complete": F.lit(True),
        }
    )


def flatten_page_result(pages: DataFrame, column: str = "groups", first: str | None = None) -> DataFrame:
    """Line rows out of nested page results groups[{region, lines[{bbox, text, confidence}]}].

    `first` names a column with the number of lines of the group in the rows before; `line_pos` goes on from there.
    """
    keys = [c for c in pages.columns if c not in (column, first)]
    before = F.lit(0) if first is None else F.col(first)
    groups = pages.select(*keys, before.alias("_before"), F.posexplode(column).alias("group_pos", "g"))
    lines = groups.select(
        *keys,
        "_before",
        "group_pos",
        F.col("g.region.label").alias("label"),
        F.col("g.region.confidence").alias("region_confidence"),
        F.posexplode("g.lines").alias("line_pos", "l"),
    )
    return lines.select(
        *keys,
        "group_pos",
        "label",
        "region_confidence",
        (F.col("_before") + F.col("line_pos")).cast("int").alias("line_pos"),
        "l.bbox.*",
        "l.text",
        "l.confidence",
    )
