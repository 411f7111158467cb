"""Fields of payloads (maps of strings, or JSON) and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# The keys that may hold a text, and a place, in order of preference.
TEXT_KEYS = ("text", "chunk_text", "content", "page_content")
ORDER_KEYS = ("chunk_index", "chunk_no", "chunk_number", "source_chunk_index", "unit_index")
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def first_text(payload: Column, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """The first value that is not blank, unchanged; empty if there is none."""
    return F.coalesce(*[F.when(T.strip(payload[k]) != "", payload[k]) for k in keys], F.lit(""))


def first_int(payload: Column, keys: tuple[str, ...] = ORDER_KEYS) -> Column:
    """The first value that is a whole number."""
    return F.coalesce(*[F.when(payload[k].rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(payload[k]).try_cast("long")) for k in keys])


def without_nulls(payload: Column) -> Column:
    return F.map_filter(payload, lambda k, v: v.isNotNull())


def is_true(x: Column, default: bool = False) -> Column:
    """A setting as a boolean; null is the default."""
    return F.when(x.isNull(), F.lit(default)).otherwise(F.lower(T.strip(x)).isin(*TRUE_WORDS))


def optional_int(x: Column) -> Column:
    """A whole number, or null."""
    return F.when(x.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(x).try_cast("long"))


def first_present(json: Column, *paths: str) -> Column:
    """The value (as a string) of the first path that is there, even if it is null there. ``paths``: a.b.c."""

    def there(path: str) -> Column:
        head, _, key = path.rpartition(".")
        keys = F.json_object_keys(json if not head else F.get_json_object(json, f"$.{head}"))
        return F.coalesce(F.array_contains(keys, key), F.lit(False))

    return F.coalesce(F.when(there(paths[0]), F.struct(F.get_json_object(json, f"$.{paths[0]}").alias("v"))), *[F.when(there(p), F.struct(F.get_json_object(json, f"$.{p}").alias("v"))) for p in paths[1:]])["v"]


def any_cited_ids(answer: Column) -> Column:
    """S numbers anywhere in the text, inside words too, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"S\d+"), F.lit(0)))


def source_block(source_id: Column, path: Column, category: Column, location: Column, text: Column) -> Column:
    """What a model is shown of a source; a missing category reads None."""
    return F.concat(F.lit("["), source_id, F.lit("]\nsource_path: "), path, F.lit("\ncategory: "), F.coalesce(category, F.lit("None")), F.lit("\nlocation: "), location, F.lit("\ncontent:\n"), text)


def display_label(path: Column, location: Column) -> Column:
    return F.concat(path, F.lit(" ("), location, F.lit(")"))


def is_thai(language: Column) -> Column:
    return F.coalesce(language.isin("th", "mixed"), F.lit(False))


def fallback_answer(language: Column, reason: Column) -> Column:
    # What is said where nothing reliable was found.
    thai = "ผมยังไม่พบข้อมูลภายในที่น่าเชื่อถือเพียงพอสำหรับยืนยันคำตอบนี้ จึงไม่ควรเดาข้อมูลครับ กรุณาตรวจสอบเอกสารภายในเพิ่มเติมหรือติดต่อทีมที่รับผิดชอบ\n\nรายละเอียด: "
    english = "I could not find sufficiently reliable internal documentation to confirm this answer, so I should not guess. Please check the relevant internal documentation or contact the responsible support team.\n\nDetails: "
    return F.concat(F.when(is_thai(language), thai).otherwise(english), reason)


def with_sources(answer: Column, inline: Column, source_ids: Column, language: Column) -> Column:
    """The answer, with a line of its sources behind it unless it cites one of them (``inline``: the ids it cites)."""
    line = F.concat(answer, F.lit("\n\n"), F.when(is_thai(language), "แหล่งข้อมูล").otherwise("Sources"), F.lit(": "), F.array_join(F.transform(source_ids, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " "))
    return F.when((F.size(source_ids) == 0) | F.arrays_overlap(inline, source_ids), answer).otherwise(line)


def history_text(messages: Column, last: int) -> Column:
    """``messages``: array of (role, content) in order. The last ones, one below the other; (none) without any."""
    lines = F.transform(F.slice(messages, F.greatest(F.size(messages) - last + 1, F.lit(1)), F.lit(last)), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.when(F.size(messages) == 0, "(none)").otherwise(F.array_join(lines, "\n\n"))


def runtime_context(now: Column, zone: str = "Asia/Bangkok") -> Column:
    """A prompt's block that tells the date; ``now`` is a timestamp."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), zone)
    # The lines of the block.
    return F.concat(
        F.lit("Runtime context:\n- Current local date: "), F.date_format(local, "yyyy-MM-dd"), F.lit("\n- Current local time: "), F.date_format(local, "HH:mm:ss"), F.lit(f"\n- Timezone: {zone}\n"),
        F.lit("- Treat dates before the current local date as past dates.\n- Treat dates after the current local date as future dates.\n- When a source document explicitly states a date, preserve the source value and interpret its timing relative to this runtime context."),
    )


def unique_name(name: Column, taken: Column, now: Column) -> Column:
    """The file name, or, where it is taken, with the time before its extension."""
    stem, extension = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(taken, F.concat(stem, F.lit("_"), F.date_format(now, "yyyyMMdd'T'HHmmss'Z'"), extension)).otherwise(name)


def per_second(n: Column, seconds: Column) -> Column:
    """A rate; null where no time passed."""
    return F.when(seconds > 0, n / seconds)
