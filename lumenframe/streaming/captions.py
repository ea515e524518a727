"""Captions and speech segments cleaned in order: rolling repeats, loops of words, phrases that speech models
invent in silence, and near-identical neighbours.

Both cleanings are folds: what is kept depends on the last lines kept. A fold holds a window of those, and
a row either changes one of them or is a new one. In batch a group's rows come sorted to one
task, which reads them as a stream and holds the window only, however long the group. As a stream
the window is the state of the group, and each change is sent as a revision of its line's number; the last
revision of each number is the batch result.

Defined results: a null text is an empty one; a null end extends nothing; a null key is a key; of
equal places the start, then the text decides; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of the cleaning of segments.
NO_SPEECH, LOG_PROBABILITY, COMPRESSION, ALIKE, REPEATS, LONGEST = 0.6, -1.0, 2.4, 0.88, 4, 4
#: Phrases that are dropped if they are a whole segment.
INVENTED = (
    "subtítulos realizados por la comunidad de amara.org", "subtitulado por la comunidad de amara.org", "subtítulos por la comunidad de amara.org",
    "subtítulos creados por la comunidad de amara.org", "gracias por ver el vídeo", "gracias por ver el video", "gracias por ver", "gracias por su atención",
    "suscríbete", "suscríbete al canal", "no olvides suscribirte", "dale like y suscríbete", "hasta la próxima", "nos vemos en el próximo vídeo",
    "este es el canal de subtítulos en español", "thank you for watching", "thanks for watching", "thank you so much for watching", "please subscribe",
    "subscribe", "like and subscribe", "don't forget to subscribe", "subscribe to my channel", "see you in the next video", "see you next time",
    "subtitles by the amara.org community", "amara.org", "you", "so",
)
#: How segments begin that are dropped.
BEGINNINGS = (
    "subtítulos realizados por", "subtítulos por", "subtitulado por", "subtítulos creados por", "este es el canal de subtítulos", "subtitles by", "captions by",
    "transcribed by", "transcripción por", "gracias por ver", "thank you for watching", "thanks for watching",
)
#: Marks of music or silence.
MUSIC = {"musica", "music", "silencio", "silence", "applause", "aplausos"}
NOTES = set("♪♫♩♬")


def plain(text: str) -> str:
    """Lower case without marks and signs, single spaces: what is compared."""
    kept = (c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", "".join(kept)).split())


_INVENTED, _BEGINNINGS = frozenset(map(plain, INVENTED)), tuple(map(plain, BEGINNINGS))


def is_invented(text: str) -> bool:
    """Whether a whole text is what models write for silence or music."""
    if all(c in NOTES or c.isspace() for c in text):
        return True
    said = plain(text)
    return not said or said in MUSIC or said in _INVENTED or "amara org" in said or said.startswith(_BEGINNINGS)


def without_loops(text: str, repeats: int = REPEATS, longest: int = LONGEST) -> tuple[str, int]:
    """``text`` with each run of ``repeats`` or more equal phrases of up to ``longest`` words made one, and how many went.
    A phrase of ``n`` words repeats for as long as words equal those ``n`` places on."""
    words = text.split()
    said = [w.lower().strip(".,!?;:") for w in words]
    same = {}
    for n in range(1, longest + 1):
        run = same[n] = [0] * (len(words) + 1)
        for i in range(len(words) - n - 1, -1, -1):
            run[i] = run[i + 1] + 1 if said[i] == said[i + n] else 0
    out, gone, i = [], 0, 0
    while i < len(words):
        n = next((n for n in range(longest, 0, -1) if 1 + same[n][i] // n >= repeats and any(said[i : i + n])), 0)
        out += words[i : i + max(n, 1)]
        times = 1 + same[n][i] // n if n else 1
        gone += times - 1
        i += max(n, 1) * times
    return (" ".join(out), gone) if gone else (text, 0)


Row = dict
#: ``(window, row) -> the place in the window that the row changed, the new row's place, or None``.
Step = Callable[[list[Row], Row], int | None]


def rolling_step(window: list[Row], row: Row) -> int | None:
    """A line equal to one of the window extends it; one that goes on from the last replaces it."""
    for k, kept in enumerate(window):
        if kept["text"] == row["text"]:
            if row["end"] is None or (kept["end"] is not None and kept["end"] >= row["end"]):
                return None
            kept["end"] = row["end"]
            return k
    if window and row["text"].startswith(window[-1]["text"] + " "):
        window[-1]["text"] = row["text"]
        if row["end"] is not None:
            window[-1]["end"] = row["end"]
        return len(window) - 1
    window.append(row)
    return len(window) - 1


def segment_step(window: list[Row], row: Row) -> int | None:
    """A doubted, looping or invented segment goes or shrinks; one like the last extends it."""
    text = row["text"].strip()
    over = lambda name, limit: row.get(name) is not None and row[name] > limit
    if not text or over("no_speech", NO_SPEECH) or over("compression", COMPRESSION) or (row.get("log_probability") is not None and row["log_probability"] < LOG_PROBABILITY):
        return None
    text = without_loops(text)[0].strip()
    if is_invented(text):
        return None
    said = plain(text)
    last = plain(window[-1]["text"]) if window else None
    if window and (last == said or difflib.SequenceMatcher(None, last, said).ratio() >= ALIKE):
        if row["end"] is None:
            return None
        window[-1]["end"] = row["end"]
        return len(window) - 1
    window.append({"start": row["start"], "end": row["end"], "text": text})
    return len(window) - 1


_FOLDS: dict[str, tuple[Step, int]] = {"rolling": (rolling_step, 3), "segments": (segment_step, 1)}
_DOUBTS = ("no_speech", "log_probability", "compression")


def _prepared(rows: DataFrame, key: str, order: str) -> DataFrame:
    doubts = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in _DOUBTS]
    return rows.select(F.col(key).alias("key"), F.col(order).cast("double").alias("place"), F.col("start").cast("double"), F.col("end").cast("double"), F.coalesce("text", F.lit("")).alias("text"), *doubts)


def _rows(frame: pd.DataFrame) -> Iterator[Row]:
    names = list(frame.columns)
    for values in frame.itertuples(index=False, name=None):
        yield {k: None if v is None or v != v else v for k, v in zip(names, values)}


def cleaned(rows: DataFrame, how: str, key: str, order: str) -> DataFrame:
    """``rows`` (``key, order, start, end, text`` and, for segments, the model's doubts) -> ``key, n, start, end, text``.
    ``how``: ``rolling`` or ``segments``."""
    step, keep = _FOLDS[how]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for k, group in groupby((r for f in frames for r in _rows(f)), key=lambda r: r["key"]):
            window: list[Row] = []
            n = 0
            for r in group:
                step(window, {x: r[x] for x in ("start", "end", "text", *_DOUBTS)})
                if len(window) > keep:
                    first = window.pop(0)
                    out.append((k, n, first["start"], first["end"], first["text"]))
                    n += 1
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["key", "n", "start", "end", "text"])
                    out = []
            out += [(k, n + i, w["start"], w["end"], w["text"]) for i, w in enumerate(window)]
        yield pd.DataFrame(out, columns=["key", "n", "start", "end", "text"])

    given = _prepared(rows, key, order)
    kind = given.schema["key"].dataType.simpleString()
    ordered = given.repartition("key").sortWithinPartitions("key", "place", "start", "text")
    return ordered.mapInPandas(run, f"key {kind}, n long, start double, end double, text string").withColumnRenamed("key", key)


def cleaned_stream(rows: DataFrame, how: str, key: str, order: str) -> DataFrame:
    """The same over a stream, whose rows come in order: revisions ``key, n, start, end, text``."""
    step, keep = _FOLDS[how]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, window = json.loads(state.get[0]) if state.exists else (0, [])
        changed: dict[int, Row] = {}
        arrived = pd.concat(list(frames)).sort_values(["place", "start", "text"], kind="stable")
        for r in _rows(arrived):
            at = step(window, {x: r[x] for x in ("start", "end", "text", *_DOUBTS)})
            if at is not None:
                changed[n + at] = {x: window[at][x] for x in ("start", "end", "text")}
            if len(window) > keep:
                window.pop(0)
                n += 1
        state.update((json.dumps([n, [{x: w[x] for x in ("start", "end", "text")} for w in window]]),))
        yield pd.DataFrame([(group[0], i, w["start"], w["end"], w["text"]) for i, w in changed.items()], columns=["key", "n", "start", "end", "text"])

    given = _prepared(rows, key, order)
    shape = T.StructType([T.StructField("key", given.schema["key"].dataType), T.StructField("n", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
    return given.groupBy("key").applyInPandasWithState(run, shape, T.StructType([T.StructField("held", T.StringType())]), "update", "NoTimeout").withColumnRenamed("key", key)
