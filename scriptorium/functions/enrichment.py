"""The optional model stage: adapters, repair of broken JSON, renamed keys. Without an adapter documents stay as they are."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names that models give to fields.
SYNONYMS = {
    "title": ("headline", "judul", "document_title"),
    "authors": ("author", "penulis", "creators"),
    "abstract": ("description", "abstrak", "executive_summary"),
    "keywords": ("kata_kunci", "tags", "index_terms"),
    "date_published": ("datePublished", "publication_date", "tanggal"),
    "sections": ("outline", "bab", "chapters"),
}


def endpoint_is_safe(url: str) -> bool:
    """http or https to a host that isn't private, local, link-local, carrier-grade or a metadata service; names of local networks aren't either."""
    try:
        parts = urlparse(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".local", ".internal", ".localhost", ".lan")):
        return False
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "." in host
    return address.is_global and not address.is_multicast


def repair_json(text: str | None) -> dict | None:
    """The outermost object of a model's answer, or null: fences go, stray backslashes are doubled, keys quoted, trailing commas dropped, open brackets closed."""
    s = re.sub(r"```[a-zA-Z]*", "", text or "")
    start = s.find("{")
    if start < 0:
        return None
    s = s[start:]
    end = s.rfind("}")
    tries = [s[: end + 1] if end >= 0 else s, s]
    for t in tries:
        fixed = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", t)
        fixed = re.sub(r"([{,]\s*)([A-Za-z_][\w-]*)\s*:", r'\1"\2":', fixed)
        fixed = re.sub(r",\s*([}\]])", r"\1", fixed)
        for candidate in (fixed, fixed + _closers(fixed)):
            try:
                got = json.loads(re.sub(r",\s*([}\]])", r"\1", candidate), strict=False)
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
    return None


def _closers(s: str) -> str:
    stack, quoted, escaped = [], False, False
    for c in s:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
    return ('"' if quoted else "") + "".join(reversed(stack))


def field(json_text: Column, name: str) -> Column:
    """A field of JSON by its name or any other name it goes by."""
    v = F.try_parse_json(json_text)
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in (name, *SYNONYMS.get(name, ()))])


def model_stage(rows: DataFrame, ask: Callable[[list[str]], list[str]] | None, prompt: str = "prompt", batch: int = 16) -> DataFrame:
    """rows with answer: repaired JSON of what `ask` (a function from prompts to answers) says, null where that failed. Without `ask` all are null."""
    if ask is None:
        return rows.withColumn("answer", F.lit(None).cast("string"))
    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("answer string").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            prompts, out = f[prompt].fillna("").tolist(), []
            for i in range(0, len(prompts), batch):
                try:
                    said = ask(prompts[i : i + batch])
                except Exception:  # the deterministic result stands
                    said = [""] * len(prompts[i : i + batch])
                out += [json.dumps(g, ensure_ascii=False) if (g := repair_json(s)) is not None else None for s in said]
            yield f.assign(answer=out)

    return rows.mapInPandas(run, schema)
