"""Prompts from retrieved chunks, as column expressions over an array of hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that prompts must hold
NOTHING_FOUND = "검색된 문서가 없습니다."
SEPARATOR = "\n\n---\n\n"
SYSTEM = {
    "default": "제공된 문서에 근거해서만 한국어로 답하고, 확인할 수 없으면 그렇게 말하세요.",
    "strict": "제공된 검색 문서 안에서만 답하세요. 추측하지 말고, 값은 문서에 나온 그대로 쓰세요.",
}
FIELDS = ("score", "doc_id", "chunk_id", "section_title", "page", "project_name", "organization", "file_name")


def context_block(hit: Column, fields: tuple[str, ...], longest: int | None = None, metadata: bool = True) -> Column:
    """[문서 rank], a line for each field, an empty line, and the text."""
    text = F.coalesce(hit["text"], F.lit(""))
    text = F.substring(text, 1, longest) if longest else text
    head = F.concat(F.lit("[문서 "), hit["rank"].cast("string"), F.lit("]"))
    if not metadata:
        return F.concat_ws("\n", head, text)
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(hit[f].cast("string"), F.lit(""))) for f in fields]
    return F.concat_ws("\n", head, *lines, F.lit(""), text)


def context(hits: Column, fields: tuple[str, ...] = FIELDS, longest: int | None = None, metadata: bool = True) -> Column:
    """All blocks of a list of hits; a notice where it is empty or null."""
    blocks = F.array_join(F.transform(hits, lambda h: context_block(h, fields, longest, metadata)), SEPARATOR)
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, blocks).otherwise(NOTHING_FOUND)


def user_prompt(question: Column, found: Column) -> Column:
    return F.concat(F.lit("[검색 문서]\n"), found, F.lit("\n\n[질문]\n"), F.coalesce(question, F.lit("")), F.lit("\n\n[답변]\n"))


def messages(question: Column, found: Column, kind: str = "default") -> Column:
    """array<struct(role, content)> of the system and the user message."""
    if kind not in SYSTEM:
        raise ValueError(f"unknown prompt {kind!r}; known: {', '.join(SYSTEM)}")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM[kind])), message("user", user_prompt(question, found)))


def retrieval_query(organization: Column, project: Column, doc_id: Column, question: Column) -> Column:
    """The question behind the lines of what else is known."""
    line = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    return F.concat_ws("\n", line("기관명", organization), line("사업명", project), line("문서ID", doc_id), line("질문", question))


def compact(hits: Column, longest: int = 1500) -> Column:
    """Hits with their text cut."""
    return F.transform(hits, lambda h: h.withField("text", F.substring(h["text"], 1, longest)))


def ids_of(hits: Column, field: str = "doc_id", unique: bool = False) -> Column:
    """Ids of the hits that have one."""
    found = F.filter(F.transform(hits, lambda h: F.trim(h[field].cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(found) if unique else found


def contexts_of(hits: Column) -> Column:
    return F.filter(F.transform(hits, lambda h: h["text"]), lambda t: t.isNotNull() & (t != ""))
