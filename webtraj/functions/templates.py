"""Chat samples and prompts assembled from their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MESSAGE = "struct<role:string,content:string>"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def chat_sample(system: Column, user: Column, assistant: Column) -> Column:
    """System, user and assistant message of one step."""
    return F.array(message("system", strip(system)), message("user", user), message("assistant", assistant))


def content_parts(text: Column, image: Column, original: Column | None = None) -> Column:
    """Multimodal content; plain text alone is the one-part case."""
    null = F.lit(None).cast("string")

    def part(kind: str, t: Column, u: Column, o: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("url"), o.alias("original_text"))

    parts = [part("text", text, null, null), part("image_url", null, image, null)]
    if original is not None:
        parts.append(part("original_text", null, null, original))
    return F.array(*parts)


def parts_of_text(text: Column) -> Column:
    """A plain string content in the multimodal shape."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("url"),
                            null.alias("original_text")))


def vision_user_text(prompt: Column, style: str = "opensource") -> Column:
    """User text of a vision sample; history lines appear only when there is a history."""
    seen = {
        "opensource": "<image>",
        "openai": "Please refer to the provided webpage screenshot for the current UI state.",
    }[style]
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Objective: "), prompt["objective"], F.lit(f"\nObservation: {seen}\n"),
                    line("HISTORY_ACTION", prompt["history_action"]), line("HISTORY_info", prompt["history_info"]))


def feedback(observation: Column, reward: Column, done: Column, is_valid: Column, wording: str = "discrete") -> Column:
    """What the environment tells the model after an action."""
    bad, good = {
        "discrete": ("Action is invalid. You stay in the same position. The observation is: \n",
                     "After you take this action, the observation is: \n"),
        "language": ("Input is invalid. The observation is: \n", "After your input, the observation is: \n"),
    }[wording]
    return F.concat(F.when(is_valid, F.lit(good)).otherwise(F.lit(bad)), observation, F.lit("\nreward: "),
                    reward.cast("string"), F.lit("\ndone: "), F.initcap(done.cast("string")), F.lit("\n"))


def wrap_turn(text: Column, done: Column) -> Column:
    """Feedback as a user turn, with the next assistant turn opened unless the episode is over."""
    return F.concat(F.lit(f"\n {TURN_START}user\n"), text, F.lit(f"{TURN_END}\n"),
                    F.when(done, F.lit("")).otherwise(F.lit(f"{TURN_START}assistant\n<think>")))


def _user_block(item: Column) -> Column:
    shown = lambda name: F.coalesce(item[name], F.lit("None"))
    return F.concat(F.lit("Objective: "), shown("question"), F.lit("\n\nURL: "), shown("url"),
                    F.lit("\nObservation:\n"), shown("observation"), F.lit("\nParsed Previous Action:\n"),
                    shown("previous_action"), F.lit("\n"))


def render_chat(history: Column, system: str, form: str = "full") -> Column:
    """Prompt text of a history array.

    ``full`` shows every item, ``single`` the first and the last, ``last`` only the last user item bare.
    Items have role, question, url, observation, previous_action and pred; a null field reads ``None``, a role
    other than system, user and assistant is an error.
    """
    if form == "last":
        return _user_block(F.try_element_at(history, F.lit(-1)))
    shown = {
        "full": history,
        "single": F.array(F.try_element_at(history, F.lit(1)), F.try_element_at(history, F.lit(-1))),
    }[form]

    def text(item: Column) -> Column:
        return (
            F.when(item["role"] == "system", F.lit(f"{TURN_START}system\n{system}{TURN_END}\n"))
            .when(item["role"] == "user", F.concat(F.lit(f"{TURN_START}user\n"), _user_block(item), F.lit(f"{TURN_END}\n\n")))
            .when(item["role"] == "assistant", F.concat(F.lit(f"{TURN_START}assistant "), F.coalesce(item["pred"], F.lit("None")), F.lit(f"\n{TURN_END}")))
            .otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(item["role"], F.lit("None")))))
        )

    return F.concat(F.array_join(F.transform(shown, text), ""), F.lit(f"{TURN_START}assistant"))


# Turn markers of the two few-shot prompt styles (the \n inside are two characters).
FEW_SHOT = {
    "inst": {"sys": ("<<SYS>>\\n", "\\n<</SYS>>\\n\\n"), "user": ("<s>[INST] ", " [/INST] "), "reply": ("", " </s>")},
    "im": {"sys": ("<|im_start|>system\\n", "<|im_end|>\\n"), "user": ("<|im_start|>user\\n", "<|im_end|>\\n"),
           "reply": ("<|im_start|>assistant\\n", "<|im_end|>\\n")},
}


def few_shot_prompt(intro: Column, examples: Column, current: Column, style: str = "im", prefix: str = "") -> Column:
    """Intro, example turns and the current input; examples are (user, reply) structs."""
    marks = FEW_SHOT[style]
    (s0, s1), (u0, u1), (r0, r1) = marks["sys"], marks["user"], marks["reply"]
    lit = F.lit

    def turn(e: Column, i: Column) -> Column:
        opening = F.when(i == 0, F.concat(lit(s0), intro, lit(s1), e["user"])).otherwise(e["user"])
        return F.concat(lit(u0), strip(opening), lit(u1), lit(r0), strip(e["reply"]), lit(r1))

    return F.concat(F.array_join(F.transform(examples, turn), ""), lit(u0), strip(current), lit(u1), lit(r0), lit(prefix))
