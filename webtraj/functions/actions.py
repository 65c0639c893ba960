"""The action language: extraction from replies, syntax dialects, parsing, rendering, equivalence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_first, first_match, last_match, let, strip, words

FENCE = "```"

# Verbs of the language and the arguments each takes.
VERBS = (
    "click", "type", "hover", "press", "scroll", "new_tab",
    "tab_focus", "close_tab", "goto", "go_back", "go_forward", "stop",
)
BARE_VERBS = ("new_tab", "close_tab", "go_back", "go_forward")

# Numeric codes of parsed actions.
CODES = {
    "none": 0, "scroll": 1, "press": 2, "mouse_click": 3, "keyboard_type": 4, "mouse_hover": 5, "click": 6, "type": 7, "hover": 8, "tab_focus": 9,
    "new_tab": 10, "go_back": 11, "go_forward": 12, "goto": 13, "close_tab": 14,
    "check": 15, "select": 16, "stop": 17,
}

# Key names whose spelling differs from the typed one.
KEY_NAMES = {name.lower(): name for name in (
    "Backquote", "Minus", "Equal", "Backslash", "Backspace", "Meta", "Tab", "Delete", "Escape",
    "ArrowDown", "End", "Enter", "Home", "Insert", "PageDown", "PageUp", "ArrowRight", "ArrowUp",
    *(f"F{i}" for i in range(1, 13)),
)}


# ---- extraction -------------------------------------------------------------------------------

def last_command(reply: Column, default: str = "") -> Column:
    """Last <action> block, else last fenced block of two or more characters, else ``default``."""
    tagged = last_match(reply, r"(?Usd)<action>\s*(.*?)\s*</action>")
    fenced = last_match(reply, r"(?Usd)```\s*(\S.*?\S)\s*```")
    return F.coalesce(
        strip(tagged), strip(F.replace(strip(fenced), F.lit(FENCE), F.lit(""))), F.lit(default)
    )


def first_command(reply: Column) -> Column:
    """First <action> block, else first fenced block, else null."""
    return strip(F.coalesce(
        first_match(reply, r"(?sd)<action>(.*?)</action>"), first_match(reply, r"(?sd)```(.*?)```")
    ))


ANCHORED = r"(?Usd)</think>\s*(?:```.*?```|<action>.*?</action>)"


def anchored_match(reply: Column) -> Column:
    """The reply's first </think> directly followed by an action block, '' if there is none."""
    return F.regexp_extract(reply, ANCHORED, 0)


def anchored_body(match: Column) -> Column:
    """Action text inside an ``anchored_match``; '' when there was none or the block is empty."""
    block = F.regexp_replace(match, r"(?U)\A</think>\s*", "")
    fenced = F.substr(block, F.lit(4), F.greatest(F.length(block) - 6, F.lit(0)))
    tagged = F.substr(block, F.lit(9), F.greatest(F.length(block) - 17, F.lit(0)))
    return strip(F.when(block.startswith(FENCE), fenced).otherwise(tagged))


def answer_tag(text: Column) -> Column:
    """Text of a one-line <answer> tag, null without one."""
    return strip(first_match(text, r"(?d)<answer>(.*?)</answer>"))


def last_conclusion(reply: Column, default: str = "") -> Column:
    return F.coalesce(
        strip(last_match(reply, r"(?Usd)<conclusion>\s*(.*?)\s*</conclusion>")), F.lit(default)
    )


def is_stop(action: Column, any_case: bool = True) -> Column:
    return (F.lower(action) if any_case else action).contains("stop")


def final_answer(action: Column) -> Column:
    """Bracketed answer of a stop action; without brackets, what is left after removing 'stop'."""
    loose = F.trim(F.replace(action, F.lit("stop"), F.lit("")), F.lit(" []"))
    return F.coalesce(strip(first_match(action, r"(?Uid)stop\s*\[(.*?)\]")), loose)


# ---- syntax dialects --------------------------------------------------------------------------

def _checker_syntax(brackets: str) -> str:
    """Patterns of the failure checker for one bracket pair; a hover may carry any tail."""
    left, right = (f"\\{b}" if b in "[]" else b for b in brackets)
    number, text = rf"{left}\d+{right}", f"{left}.*?{right}"
    with_args = (
        rf"click {number}(?: {text})?", rf"type {number} {text}(?: {left}[01]{right})?",
        rf"press {text}", rf"scroll {left}(?:down|up){right}", rf"tab_focus {number}",
        rf"goto {text}", rf"stop {text}",
    )
    return rf"hover {number}|(?:{'|'.join(with_args)})\z"


_BARE = rf"(?:{'|'.join(BARE_VERBS)})\z"
CHECKER_SYNTAX = rf"(?Ud)\A(?:{_checker_syntax('[]')}|{_checker_syntax('<>')}|{_BARE})"
ROUTER_SYNTAX = rf"(?Ud)\A(?:{_checker_syntax('[]')}|{_BARE})"
REWARD_SYNTAX = (
    r"(?Usd)\A(?:(?:click|hover)\s+\[\d+\]\s+\[.*\]"
    r"|type\s+\[\d+\]\s+\[.*\]\s+\[(?:press_enter_after=)?[01]\]"
    r"|(?:press|goto)\s+\[.+\]|scroll\s+\[(?:down|up)\]|tab_focus\s+\[\d+\]|stop\s+\[.*\]"
    rf"|{'|'.join(BARE_VERBS)})\z"
)
SYNTAX = {"checker": CHECKER_SYNTAX, "router": ROUTER_SYNTAX, "reward": REWARD_SYNTAX}


def has_syntax(action: Column, dialect: str = "checker") -> Column:
    text = strip(action) if dialect == "reward" else action
    return text.rlike(SYNTAX[dialect])


_TARGET = {
    "checker": r"(?Ud)\A(click|type|hover|tab_focus)\s+[\[<](\d+)[\]>]",
    "router": r"(?Ud)\A(click|type|hover|tab_focus)\s+\[(\d+)\]",
}


def target_verb(action: Column, dialect: str = "checker") -> Column:
    """Verb of an action that points at an element, '' for other actions."""
    return F.regexp_extract(action, _TARGET[dialect], 1)


def target_id(action: Column, dialect: str = "checker") -> Column:
    return F.regexp_extract(action, _TARGET[dialect], 2)


# ---- id-based actions -------------------------------------------------------------------------

def map_keys(key_comb: Column) -> Column:
    """Key combination with every '+'-separated key spelled the way the browser expects."""
    names = F.create_map(*[F.lit(x) for pair in KEY_NAMES.items() for x in pair])
    return F.array_join(
        F.transform(F.split(key_comb, r"\+", -1),
                    lambda k: F.coalesce(F.try_element_at(names, F.lower(k)), k)),
        "+",
    )


def _verb_of(action: Column) -> Column:
    return F.when(action.contains("["), strip(F.substring_index(action, "[", 1))).otherwise(
        F.coalesce(F.try_element_at(words(action), F.lit(1)), F.lit("")))


# Patterns of the parsed verbs; a verb without a pattern takes no arguments.
_PARSE = {
    "click": r"(?Ud)click ?\[(\d+)\]", "hover": r"(?Ud)hover ?\[(\d+)\]",
    "type": r"(?Ud)type ?\[(\d+)\] ?\[(.+)\] ?\[(\d+)\]", "press": r"(?d)press ?\[(.+)\]",
    "scroll": r"scroll ?\[?(up|down)\]?", "goto": r"(?Ud)goto ?\[(.+?)\](?: \[(\d+)\])?",
    "tab_focus": r"(?Ud)tab_focus ?\[(\d+)\]", "stop": r"(?d)stop ?\[(.+)\]",
    "select": r"(?d)select ?\[(.+)\] ?\[(.+)\]", "record": r"(?d)record ?\[(.+)\]",
}


def parse_action(action: Column) -> Column:
    """Action text as a struct; ``code`` 0 and ``valid`` false where it cannot be parsed."""
    def with_enter_flag(a: Column, verb: Column) -> Column:
        flagged = a.endswith("[0]") | a.endswith("[1]")
        return F.when((verb == "type") & ~flagged, F.concat(a, F.lit(" [1]"))).otherwise(a)

    head = let(strip(action), lambda a: F.struct(a.alias("a"), _verb_of(a).alias("verb")))
    return let(head, lambda h: let(
        F.struct(with_enter_flag(h["a"], h["verb"]).alias("a"), h["verb"].alias("verb")), _action_struct))


def _action_struct(h: Column) -> Column:
    a, verb = h["a"], h["verb"]

    def on(**cases: Column) -> Column:
        out = None
        for name, value in cases.items():
            out = F.when(verb == name, value) if out is None else out.when(verb == name, value)
        return out

    def group(name: str, index: int) -> Column:
        return F.regexp_extract(a, _PARSE[name], index)

    matched = on(**{name: a.rlike(p) for name, p in _PARSE.items() if name != "stop"})
    enter = group("type", 3) == "1"
    fields = {
        "element_id": on(**{v: group(v, 1) for v in ("click", "hover", "type", "select")}),
        "text": on(type=F.concat(group("type", 2), F.when(enter, F.lit("\n")).otherwise(F.lit(""))),
                   record=group("record", 1)),
        "flag": on(type=enter, goto=group("goto", 2) == "1"),
        "key_comb": on(press=map_keys(group("press", 1))),
        "direction": on(scroll=group("scroll", 1)),
        "url": on(goto=group("goto", 1)),
        "page_number": on(tab_focus=group("tab_focus", 1)).try_cast("int"),
        "answer": on(stop=group("stop", 1)),
        "option": on(select=group("select", 2)),
    }
    fields["pw_code"] = on(select=F.concat(F.lit('page.get_by_test_id("'), group("select", 1), F.lit('").select_option("'), group("select", 2), F.lit('")')))
    # What a text action never carries; the comparison of actions reads these, too.
    fields |= {"role": F.lit(None).cast("int"), "name": F.lit(None).cast("string"), "coords": F.lit(None).cast("array<double>")}
    code = on(**{name: F.lit(number) for name, number in CODES.items() if name not in ("none", "check", "mouse_click", "keyboard_type", "mouse_hover")})
    return let(F.coalesce(matched, verb.isin("stop", *BARE_VERBS)), lambda valid: F.struct(
        F.when(valid, F.coalesce(code, F.lit(0))).otherwise(F.lit(0)).alias("code"),
        F.when(valid, verb).alias("verb"),
        *[F.when(valid, value).alias(name) for name, value in fields.items()],
        valid.alias("valid"),
    ))


def action_text(act: Column, style: str = "tree", element: Column | None = None,
                label: Column | None = None) -> Column:
    """A parsed action back as text, in one of three renderings.

    ``tree`` names the element by id and describes it with ``element``; ``hash`` and ``call`` name it
    by ``label``.
    """
    typed = F.replace(act["text"], F.lit("\n"), F.lit(" "))
    ident, none = act["element_id"], F.lit("")
    label = F.coalesce(label if label is not None else none, none)
    element = F.coalesce(element if element is not None else none, none)
    answer = F.coalesce(act["answer"], none)
    option = F.coalesce(act["option"], none)
    # As written out by Python for True and False.
    flag = F.initcap(F.coalesce(act["flag"], F.lit(False)).cast("string"))

    def fmt(template: str, *args: Column) -> Column:
        return F.format_string(template, *args)

    if style == "tree":
        rendered = {
            "click": fmt("click [%s] where [%s] is %s", ident, ident, element),
            "type": fmt("type [%s] [%s] where [%s] is %s", ident, typed, ident, element),
            "hover": fmt("hover [%s] where [%s] is %s", ident, ident, element),
            "scroll": fmt("scroll [%s]", act["direction"]), "press": fmt("press [%s]", act["key_comb"]),
            "goto": fmt("goto [%s]", act["url"]), "go_back": F.lit("go_back"),
            "go_forward": F.lit("go_forward"), "tab_focus": fmt("page_focus [%s]", act["page_number"]),
            "stop": fmt("stop [%s]", answer), "none": F.lit("none"),
        }
    elif style == "hash":
        rendered = {
            "click": fmt("#Click# %s", label), "type": fmt("#Type# %s %s", label, typed),
            "hover": fmt("#Hover# %s", label), "scroll": fmt("#Scroll_%s#", act["direction"]),
            "press": fmt("#Press# %s", act["key_comb"]), "goto": fmt("#Goto# %s", act["url"]),
            "go_back": F.lit("#Go_backward#"), "go_forward": F.lit("#Go_forward#"),
            "tab_focus": fmt("page_focus [%s]", act["page_number"]),
            "stop": F.when(answer != "", fmt("#Answer# %s", answer)).otherwise(F.lit("#Exit#")),
            "select": fmt("#Select# %s %s", label, option), "none": F.lit("None"),
        }
    elif style == "call":
        rendered = {
            "click": fmt("click('%s')", label), "type": fmt("type_string('%s', '%s', %s)", label, typed, flag),
            "hover": fmt("hover('%s')", label), "scroll": fmt("scroll_page('%s')", act["direction"]),
            "press": fmt("press('%s')", act["key_comb"]), "goto": fmt("jump_to('%s', %s)", act["url"], flag),
            "go_back": F.lit("go('backward')"), "go_forward": F.lit("go('forward')"),
            "tab_focus": fmt("switch_tab('%s')", act["page_number"]),
            "stop": F.when(answer != "", fmt("finish('%s')", answer)).otherwise(F.lit("finish()")),
            "select": fmt("select('%s', '%s')", label, option), "none": F.lit("no_op()"),
        }
    else:
        raise ValueError(f"unknown action style {style!r}")
    out = F.when(act["verb"].isin("new_tab", "close_tab"), act["verb"])
    for verb, value in rendered.items():
        out = out.when(F.coalesce(act["verb"], F.lit("none")) == verb, value)
    return out


def action_key(act: Column) -> Column:
    """One text per class of equivalent actions, usable as a grouping or join key.

    Parsed actions always carry an element id, so clicks, hovers and typing compare by it alone.
    """
    part = (
        F.when(act["verb"].isin("click", "hover", "type", "select"), act["element_id"])
        .when(act["verb"] == "scroll", F.when(act["direction"].contains("up"), F.lit("up")).otherwise(F.lit("down")))
        .when(act["verb"] == "press", act["key_comb"])
        .when(act["verb"] == "tab_focus", act["page_number"].cast("string"))
        .when(act["verb"] == "goto", act["url"])
        .when(act["verb"] == "stop", act["answer"])
        .otherwise(F.lit(""))
    )
    extra = F.when(act["verb"] == "select", F.concat(F.lit("|"), act["option"])).otherwise(F.lit(""))
    return F.concat(act["code"].cast("string"), F.lit(":"), F.coalesce(part, F.lit("")), extra)


def equivalent(a: Column, b: Column, low_level: bool = False) -> Column:
    """Whether two action structs mean the same step.

    Elements compare by id, else by role and name, else by code. Structs are those of ``parse_action``, or such
    with ``role``, ``name`` and ``pw_code`` filled; null is unset. With ``low_level``, mouse actions compare by
    ``coords`` and keyboard actions by ``text``.
    """
    by_element = (
        F.when((a["element_id"] != "") & (b["element_id"] != ""), a["element_id"] == b["element_id"])
        .when((a["role"] != 0) & (b["role"] != 0), (a["role"] == b["role"]) & (a["name"].eqNullSafe(b["name"])))
        .when((a["pw_code"] != "") & (b["pw_code"] != ""), a["pw_code"] == b["pw_code"])
        .otherwise(F.lit(False))
    )
    code = a["code"]
    same = (
        F.when(code == CODES["scroll"], a["direction"].contains("up") == b["direction"].contains("up"))
        .when(code == CODES["press"], a["key_comb"] == b["key_comb"])
        .when(code.isin(CODES["click"], CODES["hover"], CODES["type"]), by_element)
        .when(code == CODES["tab_focus"], a["page_number"] == b["page_number"])
        .when(code == CODES["goto"], a["url"] == b["url"])
        .when(code.isin(CODES["check"], CODES["select"]), a["pw_code"] == b["pw_code"])
        .when(code == CODES["stop"], a["answer"] == b["answer"])
    )
    if low_level:
        near = lambda x, y: F.abs(x - y) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(y)
        at_place = (F.size(a["coords"]) == F.size(b["coords"])) & F.forall(F.zip_with(a["coords"], b["coords"], near), lambda ok: ok)
        same = same.when(code.isin(CODES["mouse_click"], CODES["mouse_hover"]), at_place).when(
            code == CODES["keyboard_type"], a["text"] == b["text"])
    same = same.otherwise(F.lit(True))
    return (a["code"] == b["code"]) & F.coalesce(same, F.lit(False))


def describe_action(act: Column, raw: Column, node_text: Column, splitter: str = FENCE) -> Column:
    """History line for an action: its text, or a hint on what went wrong.

    ``node_text`` is the observation line of the target element, null when no such element exists.
    """
    name = F.upper(act["verb"])
    on_element = act["verb"].isin("click", "hover", "type")
    node = F.array_join(F.slice(words(node_text), 2, F.greatest(F.size(words(node_text)), F.lit(1))), " ")
    missing = F.format_string(
        'Attempt to perfom "%s" on element "[%s]" but no matching element found. '
        "Please check the observation more carefully.", F.lower(name), act["element_id"])
    malformed = F.format_string(
        'The previous prediction you issued was "%s". However, the format was incorrect. Ensure that the '
        f"action is wrapped inside a pair of {splitter} and enclose arguments within [] as follows: "
        f"{splitter}action [arg] ...{splitter}.", raw)
    return (
        F.when(on_element & node_text.isNull(), missing)
        .when(act["code"] == 0, malformed)
        .otherwise(action_text(act, "tree", node))
    )


# ---- code-style actions -----------------------------------------------------------------------

def parse_code_action(code: Column) -> Column:
    """Code-style action text (``page.click(...)``) as a struct; ``valid`` false if unknown or malformed."""
    # Dots outside call parentheses separate the chain; the verb is the last link.
    verb = F.substring_index(F.try_element_at(F.split(code, r"\.(?![^()]*\))", -1), F.lit(-1)), "(", 1)
    quoted = lambda name: F.regexp_extract(code, rf"""(?d){name}\((?:"|')(.+?)(?:"|')\)""", 1)
    has = lambda name: code.rlike(rf"""(?d){name}\((?:"|')(.+?)(?:"|')\)""")
    # The alternation for typing is open on its left side, so the bare word "type" matches with no text.
    text = F.when(code.contains("type") & ~code.rlike(r"""(?d)\A(?:(?!type).)*fill\((?:"|')"""), F.lit("")).otherwise(
        quoted("fill"))
    page = F.regexp_extract(code, r"page_focus\((\d+)\)", 1)
    valid = (
        F.when(verb == "press", has("press"))
        .when(verb.isin("type", "fill"), code.contains("type") | has("fill"))
        .when(verb == "goto", has("goto"))
        .when(verb == "page_focus", page != "")
        .otherwise(verb.isin("scroll", "click", "hover", "select_option", "check", "new_tab",
                             "go_back", "go_forward", "page_close", "stop"))
    )
    return F.struct(
        F.when(valid, verb).alias("verb"),
        F.when(valid & verb.isin("click", "hover", "type", "fill", "select_option", "check"), code).alias("pw_code"),
        F.when(valid & (verb == "press"), map_keys(quoted("press"))).alias("key_comb"),
        F.when(verb == "scroll", F.when(code.contains("up"), F.lit("up")).otherwise(F.lit("down"))).alias("direction"),
        F.when(valid & verb.isin("type", "fill"), text).alias("text"),
        F.when(valid & (verb == "goto"), quoted("goto")).alias("url"),
        F.when(verb == "page_focus", page).try_cast("int").alias("page_number"),
        F.when(verb == "stop", F.regexp_extract(code, r"""(?d)stop\(?"(.+)?"\)""", 1)).alias("answer"),
        valid.alias("valid"),
    )


def parse_role_script(script: Column) -> Column:
    """``goto URL`` or ``get_by_role ROLE NAME OPERATION [VALUE]`` as a struct; null if malformed."""
    p = F.split(strip(script), " ", -1)
    n = F.size(p)
    at = lambda i: F.try_element_at(p, F.lit(i))
    goto = (at(1) == "goto") & (n == 2)
    role = (at(1) == "get_by_role") & n.isin(4, 5)
    return F.when(goto | role, F.struct(
        at(1).alias("function"), at(2).alias("destination"),
        F.when(role, at(3)).alias("name"), F.when(role, at(4)).alias("operation"),
        F.when(role, at(5)).alias("value"),
    ))


# ---- repairs and rewrites ---------------------------------------------------------------------

_AUTO_THINK = "<think>Auto-patched missing thought process.</think>\n"


def repair_reply(reply: Column) -> Column:
    """Supply whichever of the think and action parts a reply lacks."""
    return let(strip(reply), _repaired)


def _repaired(r: Column) -> Column:
    fine = r.rlike(r"(?Usd)<think>.*?</think>\s*(?:```.*?```|<action>.*?</action>)")
    think = r.contains("<think>") & r.contains("</think>")
    action = (r.contains("<action>") & r.contains("</action>")) | r.contains(FENCE)
    wrapped = F.concat(F.substring_index(r, "</think>", 1), F.lit("</think>\n<action>"),
                       strip(after_first(r, "</think>")), F.lit("</action>"))
    return (
        F.when(fine, r)
        .when(think & ~action, wrapped)
        .when(action & ~think, F.concat(F.lit(_AUTO_THINK), r))
        .otherwise(F.concat(F.lit(_AUTO_THINK + "<action>"), r, F.lit("</action>")))
    )


def assemble_reply(reasoning: Column, content: Column) -> Column:
    """Reasoning and content of a model reply as one text; a blank reply becomes a stop."""
    content = F.coalesce(content, F.lit(""))
    joined = F.when(F.coalesce(reasoning, F.lit("")) != "",
                    F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"), content)).otherwise(content)
    return F.when(strip(joined) == "", F.lit("<action>stop [N/A]</action>")).otherwise(joined)


def fence_to_action(text: Column, role: Column) -> Column:
    """Fenced block after </think> or </conclusion> as an <action> tag; system prompts are reworded too."""
    fence = r"(?Usd)</(think|conclusion)>\s*```\s*(.*?)\s*```"
    plain = F.regexp_replace(text, fence, "</$1>\n<action>$2</action>")
    system = F.regexp_replace(text, fence, "</$1>\n   <action>$2</action>")
    system = F.replace(system, F.lit("enclosed in code fences"), F.lit("enclosed in <action></action> tags"))
    system = F.replace(system, F.lit("```command [parameters]```"), F.lit("<action>command [parameters]</action>"))
    return F.when(role.eqNullSafe("system"), system).otherwise(plain)


def remove_click_content(text: Column, role: Column) -> Column:
    return F.regexp_replace(text, r"(?Ud)click\s+(\[\d+\])\s+\[[^\n\]]*\]", "click $1")


_MARK = "\uffff"  # a noncharacter, so it cannot occur in text


def bracket_to_angle(text: Column, role: Column) -> Column:
    """Arguments that follow a verb from [x] to <x>; brackets elsewhere stay.

    Three native passes: mark the verbs, rewrite the run of arguments that starts at each mark
    (``\\G`` continues where the previous argument ended), drop the marks.
    """
    marked = F.regexp_replace(text, rf"(?:{'|'.join(VERBS)})", f"$0{_MARK}")
    turned = F.regexp_replace(marked, rf"(?U)(?:({_MARK})|\G(?!\A))(\s+)\[([^\[\]\n]+)\]", "$1$2<$3>")
    return F.replace(turned, F.lit(_MARK), F.lit(""))


# Named text transforms; callers may register more.
TRANSFORMS = {
    "fence_to_action": fence_to_action,
    "remove_click_content": remove_click_content,
    "bracket_to_angle": bracket_to_angle,
}


def register_transform(name: str, builder) -> None:
    """Make ``builder(text: Column, role: Column) -> Column`` available by name."""
    TRANSFORMS[name] = builder


def apply_transforms(text: Column, role: Column | None = None, modes=None) -> Column:
    """The named transforms in order; none at all for None or an empty list."""
    role = role if role is not None else F.lit(None).cast("string")
    for mode in modes or ():
        text = TRANSFORMS[mode](text, role)
    return text
