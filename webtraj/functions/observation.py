"""Observation text: cleaning, busy and sparse pages, prompt blocks, accessibility lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import scan
from .text import first_match, is_blank, let, py_repr, strip

_BUSY = r"(?Uid)RootWebArea.*?busy:\s*(?:1|True)"
_BUSY_FLAG = r"(?Uid)busy:\s*(?:1|True)"


def clean_observation(raw: Column) -> Column:
    """Text between 'Observation:' and 'Parsed Previous Action:', the raw text without such a label.

    Only the piece up to a second 'Observation:' label counts.
    """
    piece = F.try_element_at(F.split(raw, "Observation:\n", 3), F.lit(2))
    return F.coalesce(F.substring_index(piece, "\nParsed Previous Action:", 1), raw)


def is_busy(observation: Column) -> Column:
    return observation.rlike(_BUSY)


def bypass_busy(observation: Column, min_chars: int = 300) -> Column:
    """Clear the busy flag of a page that is busy but already has content."""
    loaded = is_busy(observation) & (F.length(observation) > min_chars)
    return F.when(loaded, F.regexp_replace(observation, _BUSY_FLAG, "busy: False")).otherwise(observation)


def is_abandoned(observation: Column) -> Column:
    """Still busy after the bypass: the trajectory yields no rows."""
    return is_busy(bypass_busy(observation))


def is_sparse(observation: Column) -> Column:
    """Blank, or a lone root line."""
    lines = F.filter(F.split(observation, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda x: ~is_blank(x))
    return F.coalesce((F.size(lines) == 0) | ((F.size(lines) == 1) & observation.contains("RootWebArea")), F.lit(True))


def root_is_busy(busy: Column, properties: Column) -> Column:
    """Busy flag of a root node, else its first 'busy' property, taken as a truth value."""
    first = F.try_element_at(F.filter(properties, lambda p: p["name"] == "busy"), F.lit(1))
    value = F.lower(first["value"])
    return F.coalesce(busy, F.lit(False)) | F.coalesce(~value.isin("", "false", "0", "none"), F.lit(False))


# ---- elements listed in an observation --------------------------------------------------------

_ELEMENT = {
    "checker": r"(?Umd)^[\t ]*[\[<](\d+)[\]>]\s+([a-zA-Z]+)",
    "router": r"(?Umd)^[\t ]*\[(\d+)\]\s+([a-zA-Z]+)",
}


def elements(observation: Column, dialect: str = "checker") -> Column:
    """Element rows of an observation as (id, type), in order, duplicates kept."""
    pattern = F.lit(_ELEMENT[dialect])
    return F.arrays_zip(
        F.regexp_extract_all(observation, pattern, F.lit(1)).alias("id"),
        F.transform(F.regexp_extract_all(observation, pattern, F.lit(2)), F.lower).alias("type"),
    )


def element_type(observation: Column, element_id: Column, dialect: str = "checker") -> Column:
    """Lower-case type of the last line with this id, null if the id is not on the page.

    Searching for the one id costs a single scan and builds no map.
    """
    left, right = (r"[\[<]", r"[\]>]") if dialect == "checker" else (r"\[", r"\]")
    pattern = F.concat(F.lit(rf"(?Umd)^[\t ]*{left}"), element_id, F.lit(rf"{right}\s+([a-zA-Z]+)"))
    return F.lower(F.try_element_at(F.regexp_extract_all(observation, pattern, F.lit(1)), F.lit(-1)))


def element_line(observation: Column, element_id: Column) -> Column:
    """Last line of the page that lists this id, without its indent; null if absent."""
    pattern = F.concat(F.lit(r"(?md)^[\t ]*(\["), element_id, F.lit(r"\].*)$"))
    return F.try_element_at(F.regexp_extract_all(observation, pattern, F.lit(1)), F.lit(-1))


# ---- prompts ----------------------------------------------------------------------------------

def objective(content: Column) -> Column:
    """Objective up to the Observation label or the end of text; null without an Objective label."""
    return strip(first_match(content, r"(?Usd)Objective:\s*(.*?)\s*(?:\nObservation:|\Z)"))


def objective_terminated(content: Column) -> Column:
    """Objective that is followed by an Observation label; null otherwise."""
    return strip(first_match(content, r"(?Usd)Objective:\s*(.*?)\nObservation:"))


def objective_of_messages(messages: Column) -> Column:
    """Objective of the first user message that has one, '' if none has."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    found = F.filter(F.transform(users, lambda m: objective(m["content"])), lambda o: o.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def parse_prompt(content: Column) -> Column:
    """The four labelled blocks of a user prompt, trimmed; '' for a missing one."""
    def block(label: str, after: str) -> Column:
        return strip(F.regexp_extract(content, rf"(?Usd){label}:\s*(.*?)\n{after}:", 1))

    return F.struct(
        block("Objective", "Observation").alias("objective"),
        block("Observation", "HISTORY_ACTION").alias("observation"),
        block("HISTORY_ACTION", "HISTORY_info").alias("history_action"),
        strip(F.regexp_extract(content, r"(?Usd)HISTORY_info:\s*(.*)", 1)).alias("history_info"),
    )


def user_prompt(objective: Column, observation: Column, history_action: Column, history_info: Column) -> Column:
    return F.format_string(
        "\nObjective: %s\nObservation: %s\nHISTORY_ACTION: %s\nHISTORY_info: %s\n",
        objective, observation, history_action, history_info)


def user_prompt_image(objective: Column, history_action: Column, history_info: Column) -> Column:
    """Prompt whose observation is an attached image."""
    return F.format_string(
        "\nObjective: %s\nHISTORY_ACTION: %s\nHISTORY_info: %s\n\n"
        "[Please refer to the attached image for the current environment observation.]\n",
        objective, history_action, history_info)


# ---- accessibility nodes ----------------------------------------------------------------------

# Properties left out of node lines, and roles that are noise when empty.
IGNORED_PROPERTIES = ("focusable", "editable", "readonly", "level", "settable", "multiline", "invalid")
NOISE_ROLES = ("generic", "img", "list", "strong", "paragraph", "banner", "navigation", "Section",
               "LabelText", "Legend", "listitem")


def shown_properties(properties: Column) -> Column:
    return F.filter(properties, lambda p: ~p["name"].isin(*IGNORED_PROPERTIES) & p["value"].isNotNull())


def node_line(node_id: Column, role: Column, name: Column, properties: Column) -> Column:
    """``[id] role 'name' prop: value …``; properties is an array of (name, value)."""
    shown = shown_properties(properties)
    tail = F.when(F.size(shown) > 0, F.concat(F.lit(" "), F.array_join(
        F.transform(shown, lambda p: F.concat(p["name"], F.lit(": "), p["value"])), " "))).otherwise(F.lit(""))
    return F.concat(F.lit("["), node_id, F.lit("] "), role, F.lit(" "), py_repr(name), tail)


def node_is_shown(role: Column, name: Column, properties: Column, child_count: Column) -> Column:
    """Drops short childless texts and nameless noise; a nameless listitem goes even with properties."""
    short = (role == "StaticText") & (F.length(name) < 5) & (child_count == 0)
    bare = F.size(shown_properties(properties)) == 0
    empty = is_blank(name) & ((bare & role.isin(*NOISE_ROLES)) | (~bare & (role == "listitem")))
    return F.coalesce(~(short | empty), F.lit(False))


def dedup_static_text(observation: Column, lookback: int = 3) -> Column:
    """Drop a static-text line whose text already occurs in one of the last three kept lines.

    A static-text line with another kind of quoting is dropped as well. The state from line to line is the ring of the
    last kept ones, so the work is linear in the lines.
    """
    def step(state: Column, line: Column) -> Column:
        text = F.regexp_extract(line, r"(?Ud)\[\d+\] StaticText '([^']+)'", 1)
        keep = ~F.lower(line).contains("statictext") | ((text != "") & ~F.exists(state["recent"], lambda k: k.contains(text)))
        ring = F.concat(state["recent"], F.array(line))
        ring = F.slice(ring, F.greatest(F.size(ring) - (lookback - 1), F.lit(1)), lookback)
        return let(keep, lambda kept: F.struct(F.when(kept, ring).otherwise(state["recent"]).alias("recent"), kept.alias("kept")))

    start = F.struct(F.array().cast("array<string>").alias("recent"), F.lit(False).alias("kept"))
    return let(F.split(observation, "\n", -1), lambda lines: let(scan(lines, start, step, lambda s: s["kept"], "boolean"), lambda kept: F.array_join(
        F.filter(lines, lambda line, i: F.get(kept, i)), "\n")))


# ---- URLs -------------------------------------------------------------------------------------

def normalize_start_url(url: Column, entry_path: str, default_url: str, port: int = 22015) -> Column:
    """A missing URL becomes the default one; a root path on the wiki port becomes the entry page."""
    u = F.when(F.coalesce(url, F.lit("")) == "", F.lit(default_url)).otherwise(url)
    authority = F.regexp_extract(u, r"\A([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)", 2)
    scheme = F.lower(F.regexp_extract(u, r"\A([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    path = F.regexp_extract(u, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    at_port = F.regexp_extract(authority, r":(\d+)\z", 1).try_cast("int") == port
    root = scheme.isin("http", "https") & path.isin("", "/") & at_port
    return F.when(F.coalesce(root, F.lit(False)), F.concat(scheme, F.lit("://"), authority, F.lit(entry_path))).otherwise(u)


def map_urls(url: Column, mapping: list[tuple[str, str]], to_real: bool = True) -> Column:
    """Replace local addresses by real ones (or back, from http and https alike), in list order."""
    for local, real in mapping:
        if to_real:
            url = F.replace(url, F.lit(local), F.lit(real))
        else:
            url = F.replace(url, F.lit(real), F.lit(local))
            url = F.replace(url, F.lit(real.replace("http", "https")), F.lit(local))
    return url


# Dataset names recognised in paths.
DATA_SOURCES = ("nq", "hotpot", "triviaqa", "webq", "webquestions", "musique", "2wikimultihopqa")


def infer_data_source(*paths: Column) -> Column:
    """Deepest folder that names a known dataset, first path first; null if none does."""
    found = [
        F.try_element_at(F.filter(F.reverse(F.split(F.lower(p), "/", -1)), lambda x: x.isin(*DATA_SOURCES)), F.lit(1))
        for p in paths
    ]
    return F.coalesce(*found) if len(found) > 1 else found[0]
