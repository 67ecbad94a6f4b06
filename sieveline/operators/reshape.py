"""Projections between record shapes: prompts, dialogues, messages, chat templates and multiple-choice prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import strip

# The heading of a multiple-choice prompt, and what stands before its question and its answer.
CHOICE_HEADING = "以下是中国考试的单项选择题，请选出正确答案。"
CHOICE_QUESTION, CHOICE_ANSWER = "问题：", "答案："

HUMAN, ASSISTANT = ("human", "user"), ("gpt", "assistant")


def user_text(instruction: Column, extra: Column) -> Column:
    """The instruction, and a blank line and the input if that is non-empty. Null parts count as ''."""
    extra = F.coalesce(extra, F.lit(""))
    return F.concat(F.coalesce(instruction, F.lit("")), F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))


def sharegpt(user: Column, answer: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("from"), v.alias("value")) for r, v in (("human", user), ("gpt", answer))])


def messages(system: Column, history: Column, question: Column) -> Column:
    """role/content messages: a non-blank system text (trimmed), the history's turns untouched, the trimmed question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    sys_text = strip(F.coalesce(system, F.lit("")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    turns = F.flatten(F.transform(F.coalesce(history, F.array().cast("array<array<string>>")), lambda t: F.array(message("user", F.get(t, 0)), message("assistant", F.get(t, 1)))))
    return F.concat(F.when(sys_text != "", F.array(message("system", sys_text))).otherwise(none), turns, F.array(message("user", strip(question))))


def render(msgs: Column, *, generation_prompt: bool = True, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A chat template of begin/end marks around role and content, and the opening of the assistant's turn."""
    body = F.concat_ws("", F.transform(msgs, lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(end + "\n"))))
    return F.concat(body, F.lit(f"{begin}assistant\n")) if generation_prompt else body


def first_turn(turns: Column, roles: tuple[str, ...], role: str = "role") -> Column:
    """Value of the first turn of one of the roles; '' without one or with a null value."""
    return F.coalesce(F.get(F.filter(turns, lambda t: t[role].isin(*roles)), 0)["value"], F.lit(""))


def choice_prompt(question: Column, choices: list[Column], intro: str = CHOICE_HEADING) -> Column:
    lines = [F.concat(F.lit(f"{k}. "), c, F.lit("\n")) for k, c in zip("ABCDEFGH", choices)]
    return F.concat(F.lit(f"{intro}\n{CHOICE_QUESTION}"), question, F.lit("\n"), *lines, F.lit(CHOICE_ANSWER))


def completion(answer: Column, eos: str) -> Column:
    return F.concat(strip(answer), F.lit(eos))


def branches(df, keys: list[str], names: list[str], parts: list[str]):
    """Wide branch columns (name_part) as rows (keys, branch, parts)."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("branch"), *[F.col(f"{n}_{p}").alias(p) for p in parts]) for n in names])).alias("b")
    return df.select(*keys, rows).select(*keys, "b.*")
