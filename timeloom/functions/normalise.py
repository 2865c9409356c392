"""JSON of models made sure of: every field there, of the right type, capped; read once as a VARIANT, with column expressions only.

Line feeds inside strings are tolerated. What isn't JSON, or no object, gives the fields' defaults; `valid` tells it apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.config import TAGS

# Genres and kinds of video in order.
GENRES = (
    "action", "adventure", "animation", "comedy", "crime", "documentary", "drama", "family", "fantasy",
    "history", "horror", "music", "mystery", "romance", "science_fiction", "thriller", "war", "western",
)
VIDEO_TYPES = ("feature_film", "trailer", "clip_or_excerpt", "episode", "other")


def tolerant_json(text: Column) -> Column:
    """A VARIANT, null where the text isn't JSON; control characters inside strings are allowed."""
    return F.from_json(text, "variant", {"allowUnquotedControlChars": "true"})


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _string(v: Column) -> Column:
    """The trimmed text of a JSON string, "" for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string"))).otherwise(F.lit(""))


def _strings(v: Column, name: str, most: int) -> Column:
    """The first strings of a list that aren't blank."""
    return F.slice(F.filter(F.transform(_list(v, name), _string), lambda s: s != ""), 1, most)


def _list(v: Column, name: str) -> Column:
    return F.coalesce(_field(v, name, "array<variant>"), F.array().cast("array<variant>"))


def _objects(v: Column, name: str, *keys: str) -> Column:
    """The objects of a list as structs of the VARIANTs under keys: the list is read once, anything else in it is passed over."""
    kind = f"array<struct<{', '.join(f'{k}: variant' for k in keys)}>>"
    return F.filter(F.coalesce(_field(v, name, kind), F.array().cast(kind)), lambda x: x.isNotNull())


def confidence(v: Column) -> Column:
    """A number in [0, 1] from a JSON value: 0 where it is missing or empty, null where it is no number."""
    empty = v.isNull() | F.to_json(v).isin("null", '""', "[]", "{}", "false")
    number = F.try_variant_get(v, "$", "double")
    return F.when(empty, 0.0).when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def two_places(x: Column) -> Column:
    """Rounded to two places, as the double times 100 rounds; F.round goes by the shortest decimal instead, so 0.145 differs."""
    return F.round(x * 100.0) / 100.0


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _picked(v: Column) -> Column:
    """array of struct(tag, conf, evidence) of valid tags, from a list of objects or a map of confidences."""
    item = lambda tag, conf, evidence, bare: F.struct(tag.alias("tag"), conf.alias("conf"), evidence.alias("evidence"), bare.alias("bare"))
    named = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    listed = F.transform(_objects(v, "tags", "tag", "confidence", "evidence"), lambda x: item(named(x["tag"]), confidence(x["confidence"]), _string(x["evidence"]), x["evidence"].isNull()))
    mapped = F.transform(F.map_entries(_field(v, "tags", "map<string,variant>")), lambda e: item(e["key"], confidence(e["value"]), F.lit(""), F.lit(True)))
    # a tag with an empty reason is a guess
    return F.filter(F.coalesce(mapped, listed), lambda x: x["conf"].isNotNull() & (x["bare"] | (x["evidence"] != "")))


def best_of_tags(picked: Column, vocabulary: tuple[str, ...] = TAGS) -> Column:
    """Map of the picked tags of the vocabulary to struct(c, i, e): highest confidence and its evidence, the first on ties."""
    ranked = lambda t: F.transform(picked, lambda x, i: F.when(x["tag"] == t, F.struct(x["conf"].alias("c"), (-i).alias("i"), x["evidence"].alias("e"))))
    names = F.array_distinct(F.filter(F.transform(picked, lambda x: x["tag"]), lambda t: t.isin(*vocabulary)))
    return _once(names, lambda n: F.map_from_arrays(n, F.transform(n, lambda t: F.array_max(ranked(t)))))


def tag_map(best: Column, vocabulary: tuple[str, ...] = TAGS) -> Column:
    """Confidence of every tag of the vocabulary, two places; 0 if it wasn't picked."""
    names = F.array(*map(F.lit, vocabulary))
    return F.map_from_arrays(names, F.transform(names, lambda t: two_places(F.coalesce(F.try_element_at(best, t)["c"], F.lit(0.0)))))


def tag_reasons(best: Column) -> Column:
    """Evidence of each picked tag."""
    return F.transform_values(best, lambda _, b: b["e"])


def scene(text: Column) -> Column:
    """A described scene: struct(valid, title, description, characters, location, time_of_day, mood, events, tags, tag_evidence)."""
    unknown = lambda s: F.when(s != "", s).otherwise("unknown")

    def fields(v):
        return F.struct(
            v.isNotNull().alias("valid"), *[_string(_field(v, k)).alias(k) for k in ("title", "description")], _strings(v, "characters", 6).alias("characters"), _string(_field(v, "location")).alias("location"),
            unknown(_string(_field(v, "time_of_day"))).alias("time_of_day"), _string(_field(v, "mood")).alias("mood"), _strings(v, "events", 5).alias("events"),
            _once(_once(_picked(v), lambda p: best_of_tags(p)), lambda b: F.struct(tag_map(b).alias("tags"), tag_reasons(b).alias("reasons"))).alias("picked"),
        )

    done = _once(tolerant_json(text), fields)
    return _once(done, lambda d: F.struct(*[d[k].alias(k) for k in ("valid", "title", "description", "characters", "location", "time_of_day", "mood", "events")], d["picked"]["tags"].alias("tags"), d["picked"]["reasons"].alias("tag_evidence")))


def frame(text: Column) -> Column:
    """A described frame: struct(valid, caption, on_screen_text, people, setting, time_of_day, objects, shot_type, mood)."""

    def fields(v):
        s = lambda k: _string(_field(v, k)).alias(k)
        people = F.transform(_objects(v, "people", "description", "action", "expression"), lambda x: F.struct(*[_string(x[k]).alias(k) for k in ("description", "action", "expression")]))
        day = _string(_field(v, "time_of_day"))
        return F.struct(v.isNotNull().alias("valid"), s("caption"), s("on_screen_text"), F.slice(people, 1, 6).alias("people"), s("setting"), F.when(day != "", day).otherwise("unknown").alias("time_of_day"), _strings(v, "objects", 8).alias("objects"), s("shot_type"), s("mood"))

    return _once(tolerant_json(text), fields)


def chapter(text: Column) -> Column:
    """A summarised chapter: struct(valid, title, summary, events, characters, locations, mood)."""
    s = lambda v, k: _string(_field(v, k)).alias(k)
    return _once(tolerant_json(text), lambda v: F.struct(v.isNotNull().alias("valid"), s(v, "title"), s(v, "summary"), _strings(v, "events", 8).alias("events"), _strings(v, "characters", 8).alias("characters"), _strings(v, "locations", 5).alias("locations"), s(v, "mood")))


def profile(text: Column) -> Column:
    """A video's profile: struct(valid, video_type, genres, logline, plot, characters, themes, setting, tone, ending).

    Genres are of the list, with evidence, the first of each; highest confidence first. A kind that isn't known is "other".
    """

    def fields(v):
        s = lambda k: _string(_field(v, k)).alias(k)
        named = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        read = F.transform(_objects(v, "genres", "genre", "confidence", "evidence"), lambda x: F.struct(named(x["genre"]).alias("genre"), confidence(x["confidence"]).alias("confidence"), _string(x["evidence"]).alias("evidence")))
        good = F.filter(read, lambda g: g["genre"].isin(*GENRES) & (g["evidence"] != "") & g["confidence"].isNotNull())
        first = _once(good, lambda a: F.filter(a, lambda g, i: F.array_position(F.transform(a, lambda x: x["genre"]), g["genre"]) == i + 1))
        ranked = F.sort_array(F.transform(first, lambda g, i: F.struct((-g["confidence"]).alias("c"), i.alias("i"), g.alias("g"))))
        genres = F.transform(ranked, lambda x: F.struct(x["g"]["genre"].alias("genre"), two_places(x["g"]["confidence"]).alias("confidence"), x["g"]["evidence"].alias("evidence")))
        people = F.transform(_objects(v, "characters", "name", "role", "description"), lambda x: F.struct(*[_string(x[k]).alias(k) for k in ("name", "role", "description")]))
        kind = F.when(F.schema_of_variant(_field(v, "video_type")) == "STRING", _field(v, "video_type", "string"))
        return F.struct(
            v.isNotNull().alias("valid"), F.when(kind.isin(*VIDEO_TYPES), kind).otherwise("other").alias("video_type"), genres.alias("genres"), s("logline"), s("plot"),
            F.slice(F.filter(people, lambda x: x["name"] != ""), 1, 10).alias("characters"), _strings(v, "themes", 5).alias("themes"), s("setting"), s("tone"), s("ending"),
        )

    return _once(tolerant_json(text), fields)


def fields(rows: DataFrame, text: str, read: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """Columns `keep` with the fields that `read` finds in a text column: through a generator, so that the JSON is read once a row whatever is selected."""
    return rows.select(*keep, F.inline(F.array(read(F.col(text)))))
