"""Caption files to cues to timed words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{T.SPACE}+"), lambda w: w != "")


def parse(files: DataFrame, *, item: str = "item_id", body: str = "body", references=T.references, strict: bool = True) -> DataFrame:
    """(item_id, ordinal, start, end, text) of the cues of VTT or SRT bodies.

    A cue is the first line of a block that has an arrow; the rest of the block, up to a blank line, is its text, another arrow line too.
    What follows a time on its line is passed over. A cue without text is none. A time that can't be read (HH:MM:SS.mmm it has to be) is an
    error if strict; else hours may be left out, and cues whose times still can't be read are those of `unread`. Ordinals count blocks and
    may have gaps.
    """
    cues = _cues(files, item, body, references, strict)
    return cues.filter((F.col("text") != "") & F.col("start").isNotNull() & F.col("end").isNotNull()).drop("line")


def unread(files: DataFrame, *, item: str = "item_id", body: str = "body") -> DataFrame:
    """(item_id, ordinal, line) of the cues with a text that `parse` leaves out if it isn't strict."""
    cues = _cues(files, item, body, T.references, False)
    return cues.filter((F.col("text") != "") & (F.col("start").isNull() | F.col("end").isNull())).select("item_id", "ordinal", "line")


#: Folders that `write` spreads its files over.
FOLDERS = 64


def write(bodies: DataFrame, folder: str, *, item: str = "item_id", body: str = "body") -> None:
    """Caption files, one an item, as `folder`/number/item.vtt; `read` has them back from `folder`/*.

    The executors write each file under a name of its own and rename it when whole, without a folder an item or a commit that goes over all
    files. An item's name has to do as a file's; null is an error. A null body is an empty file.
    """
    run_id = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        made = set()
        for batch in batches:
            for name, part, text in zip(*batch.columns):
                at = f"{base}/{part.as_py()}"
                if at not in made:
                    fs.create_dir(at, recursive=True)
                    made.add(at)
                temp = f"{at}/.{run_id}-{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(text.as_buffer())
                fs.move(temp, f"{at}/{name.as_py()}.vtt")
            yield pa.record_batch([batch.column(0)], ["item"])

    name = F.col(item).cast("string")
    named = F.when(name.isNull() | (name == "") | name.startswith(".") | name.startswith("_") | name.contains("/"), F.raise_error(F.concat(F.lit("no name for a caption file: "), F.coalesce(name, F.lit("null")))).cast("string")).otherwise(name)
    rows = bodies.select(named.alias("item"), F.pmod(F.xxhash64(name), F.lit(FOLDERS)).alias("part"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("body"))
    rows.mapInArrow(run, "item string").write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, path: str, *, item: Column | None = None) -> DataFrame:
    """(item_id, body) of caption files, UTF-8 with what is malformed replaced; `item` is made of the column path, and is the file's stem if left out.

    Folders are listed in a task each; so is every file that a pattern for files stands for, so many are better given by their folders.
    """
    # a scan has a task for every few small files; a narrow coalesce takes them one after another
    files = spark.read.format("binaryFile").load(path).coalesce(8 * spark.sparkContext.defaultParallelism)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select((stem if item is None else item).alias("item_id"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "").alias("body"))


def _cues(files: DataFrame, item: str, body: str, references, strict: bool) -> DataFrame:
    blocks = F.split(F.regexp_replace(F.col(body), r"\r\n?|[\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n"), r"\n[ \t\f\x0b]*(?=\n)")
    rows = files.select(F.col(item).alias("item_id"), F.posexplode(blocks).alias("ordinal", "block"))
    line = F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1)
    left = F.split(F.btrim(F.regexp_extract(line, r"^(.*?)-->", 1)), r"\s+")[0]
    right = F.regexp_extract(line, r"-->\s*(\S+)", 1)
    rest = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " ")
    cue = F.struct(T.seconds(left, strict=strict).alias("start"), T.seconds(right, strict=strict).alias("end"), T.clean_markup(rest, references).alias("text"), line.alias("line"))
    # a generator, so that what filters these columns doesn't have them worked out again
    return rows.filter(F.col("block").contains("-->")).select("item_id", "ordinal", F.inline(F.array(cue)))


def drop_overlap(cues: DataFrame, *, item: str = "item_id", order: str = "ordinal", text: str = "text") -> DataFrame:
    """Cues without the words that roll over from the cue before: its longest tail that the cue starts with.

    Compared with the whole cue before, dropped or not; cues without words are left out first. A cue of which nothing is left goes.
    """
    w = Window.partitionBy(item).orderBy(order)
    rows = cues.withColumn("_w", tokens(F.col(text))).filter(F.size("_w") > 0).withColumn("_p", F.lag("_w").over(w))
    overlap = F.expr("if(_p is null, 0, coalesce(array_max(filter(sequence(1, least(size(_p), size(_w))), k -> _w[k - 1] = _l and _p[size(_p) - k] = _f and slice(_p, -k, k) = slice(_w, 1, k))), 0))")
    # the last and the first word rule nearly all lengths out before the slices are made
    rows = rows.withColumns({"_l": F.element_at("_p", -1), "_f": F.element_at("_w", 1)}).withColumn("_o", overlap).filter(F.col("_o") < F.size("_w"))
    fresh = F.expr("array_join(slice(_w, _o + 1, size(_w)), ' ')")
    out = rows.withColumn(text, T.normalize(fresh)).filter(F.col(text) != "")
    return out.select(*cues.columns)


def words(cues: DataFrame, probability: Column | float = 1.0, *, item: str = "item_id", order: str = "ordinal") -> DataFrame:
    """(item_id, cue, position, word, start, end, probability, timing_source): the words of each cue, evenly over its span of at least 0.01 s."""
    w = tokens(F.col("text"))
    rows = cues.withColumn("_n", F.size(w)).withColumn("_step", F.greatest(F.lit(0.01), F.col("end") - F.col("start")) / F.nullif("_n", F.lit(0)))
    p = F.lit(probability) if isinstance(probability, float) else probability
    rows = rows.withColumn("probability", p)
    at = lambda k: F.round(F.col("start") + k * F.col("_step"), 3)
    return rows.select(item, F.col(order).alias("cue"), "start", "_step", "probability", F.posexplode(w).alias("position", "word")).select(
        item, "cue", "position", "word", at(F.col("position")).alias("start"), at(F.col("position") + 1).alias("end"), "probability", F.lit("subtitle").alias("timing_source")
    )


def confidence(automatic: Column) -> Column:
    """What a caption's words are trusted: less if they were made by a machine."""
    return F.when(automatic, F.lit(0.82)).otherwise(F.lit(1.0))


def asr_words(segments: DataFrame, *, max_no_speech: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """Recognised segments to (segments with their confidence, words).

    `segments` has item_id, ordinal, avg_logprob, no_speech_probability and words (array of word, start, end, probability). A mean log
    probability that is null or exactly 0 counts as -99. Words of segments above `max_no_speech` are dropped, as are empty ones and those
    without times; the segments stay.
    """
    logp = F.coalesce(F.nullif(F.col("avg_logprob"), F.lit(0.0)), F.lit(-99.0))
    known = segments.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + logp / 4)))
    w = known.filter(F.coalesce("no_speech_probability", F.lit(0.0)) <= max_no_speech).select("item_id", F.col("ordinal").alias("cue"), F.posexplode("words").alias("position", "w"), F.col("confidence").alias("segment_confidence"))
    w = w.select("item_id", "cue", "position", F.btrim("w.word").alias("word"), "w.start", "w.end", "w.probability", "segment_confidence")
    return known.drop("words"), w.filter((F.col("word") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())


def choose(index: DataFrame, languages: list[str], *, automatic: bool = True, item: str = "item_id") -> DataFrame:
    """(item_id, language, url, ext, kind) of the caption to fetch: made by hand if there is one, else automatic where allowed.

    `index` has subtitles and automatic_captions, maps of language to an array of (ext, url). The first listed language with a usable entry
    wins, and in it vtt before srt, then the first. Usable is a url and one of these kinds. Items without one have nulls.
    """

    def best(col: str) -> Column:
        def usable(lang: str) -> Column:
            entries = F.coalesce(F.element_at(F.col(col), F.lit(lang)), F.array().cast("array<struct<ext:string,url:string>>"))
            ok = F.filter(entries, lambda e: e["url"].isNotNull() & (e["url"] != "") & e["ext"].isin("vtt", "srt"))
            by_kind = F.concat(F.filter(ok, lambda e: e["ext"] == "vtt"), F.filter(ok, lambda e: e["ext"] == "srt"))
            first = F.get(by_kind, F.lit(0))
            return F.when(first.isNotNull(), F.struct(F.lit(lang).alias("language"), first["url"].alias("url"), first["ext"].alias("ext")))

        return F.coalesce(*[usable(lang) for lang in languages])

    hand = best("subtitles")
    made = best("automatic_captions") if automatic else F.lit(None)
    rows = index.withColumn("_h", hand).withColumn("_a", made.cast("struct<language:string,url:string,ext:string>"))
    one = F.coalesce("_h", "_a")
    return rows.select(item, one["language"].alias("language"), one["url"].alias("url"), one["ext"].alias("ext"), F.when(F.col("_h").isNotNull(), "manual").when(F.col("_a").isNotNull(), "automatic").alias("kind"))
