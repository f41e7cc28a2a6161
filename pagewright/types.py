"""Kinds, states and record types that tables and hosts share."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from .operators.reading import NOTE, SPAN, STEP
from .sources.docjson import ELEMENT


class RunStatus(StrEnum):
    ANSWERED = "answered"
    NOT_IN_DOCUMENT = "not_in_document"
    INSUFFICIENT_EVIDENCE = "insufficient_evidence"
    BUDGET_EXHAUSTED = "budget_exhausted"
    FAILED = "failed"


class UnitKind(StrEnum):
    SECTION = "section"
    PAGE = "page"
    DOCUMENT = "document"


class StructuredMode(StrEnum):
    JSON_SCHEMA = "json_schema"
    JSON_OBJECT = "json_object"
    NONE = "none"


#: Row types in Spark's notation.
ROWS = {
    "element": ELEMENT,
    "span": SPAN,
    "step": STEP,
    "note": NOTE,
    "unit": "struct<doc_id:bigint,ord:int,ref:string,kind:string,title:string,level:int,page_no:int,pages:array<int>,char_len:bigint,summary:string,keywords:array<string>,lead:string,element_refs:array<string>,text:string>",
    "candidate": "struct<query_id:bigint,doc_id:bigint,place:int,ref:string,score:double,rationale:string>",
    "scope": "struct<doc_id:bigint,ord:int,ref:string,section_no:bigint>",
    "excerpt": "struct<doc_id:bigint,ref:string,focus:string,text:string,kind:string,truncated:boolean>",
    "trace": f"struct<query:string,answer:string,status:string,model_id:string,steps:array<{STEP}>,llm_calls:int,elapsed_s:double,notes:array<string>,converged:boolean>",
}


@dataclass(frozen=True)
class Iteration:
    """One read in the flat shape."""

    iteration: int
    section_ref: str
    reason: str
    section_text_length: int
    can_answer: bool
    response: str


@dataclass(frozen=True)
class Result:
    """A run in the flat shape."""

    answer: str
    iterations: list
    converged: bool
