"""Answers of a judge model: JSON out of free text, verdicts, checklists, issue lists, and the scoring of probes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import strip

# ---- fixed values
CONFIDENCES, TRUE_WORDS = ("high", "medium", "low"), ("true", "yes", "1")
LEAST_SHARE, LEAST_FOUND, MOST_FALSE = 0.6, 3, 2
RATE_LIMIT_BASE, RATE_LIMIT_GROWTH = 8.0, 2.0
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
# ----
_STRING_OR_MARK = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?$)|[{}\[\]]|[^"{}\[\]]+', re.DOTALL)
_CLOSES = {"{": "}", "[": "]"}


def unfenced(raw: Column) -> Column:
    """An answer without the fences around it."""
    return strip(F.regexp_replace(strip(raw), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def json_span(text: Column) -> Column:
    """From the first opening brace to the last closing one, or to the end where none follows; empty without an opening one."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    whole = F.substr(text, first)
    return F.when(first == 0, "").when(F.contains(text, F.lit("}")) & (last > first), F.substr(text, first, last - first + 1)).otherwise(whole)


def mend(text: str) -> str:
    """JSON with what often goes wrong put right: control characters inside strings, closing marks that nothing opened, strings and
    marks left open, and commas before a closing mark, inside strings too."""
    out, due = [], []
    for token in _STRING_OR_MARK.findall(text):
        if token[0] == '"':
            body = "".join(ESCAPES.get(c, c if c >= " " else " ") for c in token)
            closed = len(token) > 1 and re.search(r'(?<!\\)(?:\\\\)*"$', token[1:])
            out.append(body if closed else body + '"')
        elif token in _CLOSES:
            due.append(_CLOSES[token])
            out.append(token)
        elif token in ("}", "]"):
            if due[-1:] == [token]:
                out.append(due.pop())
        else:
            out.append(token)
    text = re.sub(r",(\s*[}\]])", r"\1", "".join(out + due[::-1]))
    return "".join(c if c >= " " or c in "\n\r\t" else " " for c in text)


def decode(text: str) -> tuple[dict | None, str]:
    """The JSON object that a text begins with, has in it, or would have if mended; and why there is none."""
    error = "empty JSON response"
    first, last = text.find("{"), text.rfind("}")
    inside = text[first : last + 1 if last > first else None] if first >= 0 else ""
    for form in (lambda: text, lambda: inside, lambda: mend(inside)):
        if not (candidate := form().lstrip()):
            break
        try:
            found, _ = json.JSONDecoder().raw_decode(candidate)
        except json.JSONDecodeError as e:
            error = str(e)
            continue
        if isinstance(found, dict):
            return found, ""
        error = f"expected JSON object, got {type(found).__name__}"
    return None, error


def _number(x, default):
    return x if isinstance(x, (int, float)) else default


def verdict_of(text: str, names: list[str]) -> dict:
    """Fields of a verdict with their defaults; confidence is error where the text has no object or prefers none of the names."""
    data, error = decode(text)
    if data is not None and data.get("preferred", "") not in names:
        data, error = None, f"unknown adapter {data.get('preferred', '')!r}"
    if data is None:
        return {"preferred": "", "confidence": "error", "reasoning": "", "overall_confidence": None, "violations": [], "error": error}
    rows = data.get("violations")
    found = [
        {
            "type": str(v.get("type", "unknown")), "severity": str(v.get("severity", "major")), "count": max(1, int(_number(v.get("count", 1), 1))),
            "pages": [int(p) for p in v.get("pages", []) if isinstance(p, (int, float))], "confidence": float(_number(v.get("confidence", 0.0), 0.0)),
            "evidence": str(v.get("evidence", "")), "root_cause": str(v.get("root_cause", "")),
        }
        for v in (rows if isinstance(rows, list) else []) if isinstance(v, dict)
    ]
    overall = _number(data.get("overall_confidence"), None)
    said = data.get("confidence", "medium")
    return {"preferred": data["preferred"], "confidence": said if said in CONFIDENCES else "medium", "reasoning": str(data.get("reasoning", "")), "overall_confidence": None if overall is None else float(overall), "violations": found, "error": ""}


VERDICT = (
    "preferred string, confidence string, reasoning string, overall_confidence double, violations array<struct<type:string,severity:string,count:long,pages:array<long>,"
    "confidence:double,evidence:string,root_cause:string>>, error string"
)
_VIOLATION = pa.struct([("type", pa.string()), ("severity", pa.string()), ("count", pa.int64()), ("pages", pa.list_(pa.int64())), ("confidence", pa.float64()), ("evidence", pa.string()), ("root_cause", pa.string())])
_KINDS = {"preferred": pa.string(), "confidence": pa.string(), "reasoning": pa.string(), "overall_confidence": pa.float64(), "violations": pa.list_(_VIOLATION), "error": pa.string()}


def verdicts(responses: DataFrame, names: list[str]) -> DataFrame:
    """responses: call_id, raw.  call_id and the verdict's fields; a null answer is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict_of(x.as_py() or "", names) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("call_id"), *(pa.array([f[k] for f in found], t) for k, t in _KINDS.items())], names=["call_id", *_KINDS])

    return responses.select("call_id", unfenced(F.col("raw")).alias("text")).mapInArrow(run, f"call_id long, {VERDICT}")


def checklist(raw: Column, keys: list[str]) -> Column:
    """A struct of booleans, true where the answer's object says so in one of TRUE_WORDS; false for what is absent."""
    said = F.from_json(json_span(unfenced(raw)), "map<string,string>")
    return F.struct(*(F.coalesce(F.lower(said[k]).isin(*TRUE_WORDS), F.lit(False)).alias(k) for k in keys))


def matched_issues(reports: list[str], gold: list[list[list[str]]]) -> dict[str, int]:
    """How reports meet the gold issues, each a list of groups of which some term must occur: a report takes the first open issue that
    it satisfies, is a duplicate if it satisfies only taken ones, and else a false positive."""
    taken: set[int] = set()
    count = {"matched": 0, "duplicates": 0, "false_positives": 0}
    for report in reports:
        text = report.lower()
        fits = [i for i, groups in enumerate(gold) if all(any(t.lower() in text for t in g) for g in groups)]
        free = next((i for i in fits if i not in taken), None)
        taken |= {free} if free is not None else set()
        count["matched" if free is not None else "duplicates" if fits else "false_positives"] += 1
    return count


def probe_passes(expected_found: Column, controls_flagged: Column, expected: int) -> Column:
    return (expected_found >= int(expected * LEAST_SHARE)) & (controls_flagged == 0)


def freeform_passes(matched: Column, false_positives: Column) -> Column:
    return (matched >= LEAST_FOUND) & (false_positives <= MOST_FALSE)


def retry_delay(retry_after: Column, attempt: Column, base: float = RATE_LIMIT_BASE) -> Column:
    """Seconds to wait after a rate limit: what the answer asks for, if a number, else base doubled with each attempt."""
    asked = F.trim(retry_after).try_cast("double")
    return F.coalesce(F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0))), F.lit(base) * F.pow(F.lit(RATE_LIMIT_GROWTH), attempt - 1))
