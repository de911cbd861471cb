"""From raw payloads and pages to entities, edges, plain text and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import service_docs as sd

CHARS_PER_TOKEN = 4
_BLOCK = r"(?i)</?(p|div|br|tr|table|ul|ol|section|article|header|footer|nav|blockquote|pre|h[1-6]|li)\b[^>]*>"
#: parts of a page that are no text, with all in them (fixed values)
NO_TEXT = ("script", "style", "head", "title", "noscript", "template")
#: page to text: (pattern, replacement), in this order; no pattern looks back or ahead
HTML_STEPS = (
    (r"(?s)<!--.*?-->", ""), *((rf"(?is)<{tag}\b.*?</{tag}\s*>", "") for tag in NO_TEXT),
    *((rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)), (r"(?i)<li\b[^>]*>", "\n- "), (_BLOCK, "\n"), (r"<[^>]*>", ""),
)
#: after character references have become characters
SPACE_STEPS = ((r"[ \t\r\x{A0}]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+", ""), (r"\s+$", ""))
#: lists within lists of a rich-text tree
LEVELS = 16


def unescaped(text: Column) -> Column:
    """Character references as characters: numbers in both forms, and names; what is none stays."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, code)])

    def shown(part: Column) -> Column:
        end = F.locate(";", part)
        name = F.substring(part, F.lit(1), end - 1)
        number = F.when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, F.lit(3), end), 16, 10).cast("int")).when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, F.lit(2), end).cast("int"))
        code = F.coalesce(number, named[name], F.when(name == "apos", 39))
        known = (end > 1) & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.substring(part, end + 1, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), shown), ""))


def html_to_text(html: Column) -> Column:
    """Text of a page: headings get hashes and list items dashes, blocks are lines; scripts,
    styles, comments, the page's head and what shows without scripts alone go; character
    references become characters, and of blank lines one stays."""
    out = F.coalesce(html, F.lit(""))
    for pattern, replacement in HTML_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.when(F.contains(out, F.lit("&")), unescaped(out)).otherwise(out)
    for pattern, replacement in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def rich_text(tree: Column) -> Column:
    """Texts of a nested rich-text tree (JSON), in document order.  A node's text is its text; a
    node without one is the texts of its content, and a list those of its members, with a
    space between each two (empty ones too) and without white space at both ends.  Nothing
    else of a node counts, its attributes neither.  What isn't a JSON object or list stays as
    it is; null is empty.  Lists may lie ``LEVELS`` deep; what is deeper is left out."""
    node = F.try_parse_json(tree)
    return F.when(F.coalesce(tree, F.lit("")).rlike(r"^\s*[\[{]") & node.isNotNull(), _node_text(node, LEVELS)).otherwise(F.coalesce(tree, F.lit("")))


def _node_text(node: Column, levels: int) -> Column:
    part = lambda path, kind: F.try_variant_get(node, path, kind)
    text = F.when(F.schema_of_variant(part("$.text", "variant")) == "STRING", part("$.text", "string"))
    members = F.coalesce(part("$", "array<variant>"), F.when(text.isNull(), part("$.content", "array<variant>")))
    inner = F.btrim(F.array_join(F.transform(members, lambda m: _node_text(m, levels - 1)), " "), F.lit(" \t\n\r\f\x0b")) if levels else F.lit("")
    plain = F.when(part("$", "map<string,variant>").isNull(), part("$", "string"))
    return F.coalesce(F.when(members.isNotNull(), inner), text, plain, F.lit(""))


def store_identity(text: Column) -> Column:
    """STRUCT<type, host, database> of a connection string or URL; users and passwords are
    never in it; null for none."""
    url = r"^(?:jdbc:)?([a-z][a-z0-9+]*):(?:[a-z0-9]+:)?//(?:[^@/]*@)?([^/:;?,]+)(?::\d+)?(?:[,:][^/;?]*)?(?:/([^?;]*))?"
    low = F.lower(text)
    scheme = F.regexp_extract(low, url, 1)
    field = lambda names: F.regexp_extract(text, rf"(?i)(?:^|;)\s*(?:{names})\s*=\s*(?:tcp:)?([^;,]+)", 1)
    server, base = F.lower(field("server|data source|host|addr(?:ess)?|accountendpoint")), field("database|initial catalog")
    named = F.regexp_extract(low, r"database(?:name)?=([^;]+)", 1)
    kind = F.when(scheme.isin("postgres", "postgresql"), "postgresql").when(scheme.isin("mongodb", "mongodb+srv"), "mongodb").when(scheme.isin("redis", "rediss"), "redis").when(scheme.isin("sqlserver", "mssql"), "sqlserver").otherwise(scheme)
    none = lambda c: F.when(c != "", c)
    from_url = F.struct(kind.alias("type"), none(F.regexp_extract(low, url, 2)).alias("host"), none(F.coalesce(none(F.regexp_extract(text, "(?i)" + url, 3)), named)).alias("database"))
    from_fields = F.struct(F.lit("sqlserver").alias("type"), none(server).alias("host"), none(base).alias("database"))
    return F.when(scheme.isin("http", "https"), None).when(scheme != "", from_url).when(server != "", from_fields)


# payloads

def _entity(df: DataFrame, label: str, source_id: Column, name: Column, status: Column | None = None, updated: Column | None = None, once: bool = True) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = df.select(F.lit(label).alias("label"), source_id.alias("source_id"), name.alias("name"), (none if status is None else status).alias("status"), (none if updated is None else updated).alias("updated_at")).where("source_id is not null")
    return rows.distinct() if once else rows


def _edge(df: DataFrame, source: Column, rel: str, target: Column) -> DataFrame:
    return df.select(source.alias("source_id"), F.lit(rel).alias("rel_type"), target.alias("target_id")).where("source_id is not null and target_id is not null").distinct()


def extract_repo(repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of repositories (id, name, full_name, owner STRUCT<login>,
    updated_at): the repository holds the service of its name."""
    repo, service = F.concat(F.lit("repo:"), F.coalesce("full_name", "name")), F.concat(F.lit("service:"), F.lower("name"))
    entities = _entity(repos, "Repository", repo, F.col("name"), None, F.col("updated_at")).unionByName(_entity(repos, "Service", service, F.col("name")))
    return entities, _edge(repos, repo, "CONTAINS", service)


def extract_pr(requests: DataFrame, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of pull requests (repo, number, title, state, merged_at, user
    STRUCT<login, name>, updated_at): each modifies its repository and has an author.  Not
    ``once``: a request is there as often as it is told, for a merge that takes one by id."""
    pr, person = F.concat_ws("#", F.concat(F.lit("pr:"), "repo"), F.col("number").cast("string")), F.concat(F.lit("person:"), F.lower("user.login"))
    status = F.when(F.col("merged_at").isNotNull(), "merged").otherwise(F.col("state"))
    entities = _entity(requests, "PullRequest", pr, F.col("title"), status, F.col("updated_at"), once).unionByName(_entity(requests, "Person", person, F.coalesce("user.name", "user.login")))
    return entities, _edge(requests, pr, "MODIFIES", F.concat(F.lit("repo:"), "repo")).unionByName(_edge(requests, pr, "AUTHORED_BY", person))


def extract_issue(issues: DataFrame, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of tickets (key, kind, summary, status, parent, assignee
    STRUCT<accountId, displayName>, updated): tickets and epics, their assignees, and which
    epic a ticket belongs to.  ``once`` as in ``extract_pr``."""
    ticket, person = F.concat(F.lit("ticket:"), "key"), F.concat(F.lit("person:"), "assignee.accountId")
    epic = F.lower(F.coalesce("kind", F.lit(""))) == "epic"
    both = _entity(issues.where(epic), "Epic", ticket, F.col("summary"), F.col("status"), F.col("updated"), once).unionByName(_entity(issues.where(~epic), "Ticket", ticket, F.col("summary"), F.col("status"), F.col("updated"), once))
    entities = both.unionByName(_entity(issues, "Person", person, F.col("assignee.displayName")))
    return entities, _edge(issues, ticket, "ASSIGNED_TO", person).unionByName(_edge(issues, ticket, "PART_OF", F.concat(F.lit("ticket:"), "parent")))


def extract_page(pages: DataFrame) -> DataFrame:
    """Entities of wiki pages (id, title, html, updated_at) with their text."""
    return pages.select(F.lit("Page").alias("label"), F.concat(F.lit("page:"), F.col("id").cast("string")).alias("source_id"), F.col("title").alias("name"), html_to_text(F.col("html")).alias("description"), F.col("updated_at"))


# chunks

_HEADING = re.compile(r"(#{1,4})\s+(.*)")
_FENCE = re.compile(r"\s*(```|~~~)")
#: where a text that is too long is cut: after blank lines, else after sentences, else lines, else words
_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"[.!?]\s+"), re.compile(r"\n"), re.compile(r"\s+"))


def pieces(text: str, most: int, cuts: tuple = _CUTS) -> list[str]:
    """Consecutive parts of ``text``, each of at most ``most`` characters, as few as fit."""
    if len(text) <= most:
        return [text] if text else []
    if not cuts:
        return [text[i : i + most] for i in range(0, len(text), most)]
    ends = [m.end() for m in cuts[0].finditer(text)]
    parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) <= most:
            out[-1] += part
        else:
            out += pieces(part, most, cuts[1:])
    return out


def sections(text: str) -> list[tuple[str, str, str]]:
    """(path of headings, title, text) of the parts that headings of four levels begin,
    outside of fences; joined they are the text."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[int, str]] = []
    held, title, fenced = "", "", False
    for line in text.splitlines(keepends=True):
        if _FENCE.match(line):
            fenced = not fenced
        met = None if fenced else _HEADING.fullmatch(line.rstrip("\r\n"))
        if met:
            if held:
                out.append((" > ".join(x for _, x in stack), title, held))
            level, title, held = len(met[1]), met[2].strip(), ""
            stack = [x for x in stack if x[0] < level] + [(level, f"{met[1]} {met[2].strip()}")]
        held += line
    if held:
        out.append((" > ".join(x for _, x in stack), title, held))
    return out


def markdown_chunks(text: str, most: int, least: int) -> list[tuple[str, str, str]]:
    """(path, title, part of the text): sections, cut if too long; parts that are too short
    take in the next ones."""
    out: list[list[str]] = []
    for path, title, body in sections(text):
        for part in pieces(body, most):
            if out and len(out[-1][2]) < least:
                out[-1][2] += part
            else:
                out.append([path, title, part])
    return [tuple(x) for x in out]


def chunk_markdown(docs: DataFrame, most: int = 500, least: int = 200) -> DataFrame:
    """(doc_id, chunk_index, section_title, display_text, original_segment) of documents
    (doc_id, text): sections of at most ``most`` tokens (a token is four characters); the
    path of headings stands before each text.  The segments of a document, joined, are
    its text.  A part of less than ``least`` tokens takes in the next, so a chunk may have
    nearly ``least`` tokens more than ``most``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for i, (path, title, part) in enumerate(markdown_chunks(text or "", most * CHARS_PER_TOKEN, least * CHARS_PER_TOKEN)):
                    body = part.split("\n", 1)[1] if _HEADING.match(part) and "\n" in part else "" if _HEADING.match(part) else part
                    rows.append((doc_id, i, title, f"{path}\n\n{body.strip()}".strip() or part, part))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_title", "display_text", "original_segment"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_index int, section_title string, display_text string, original_segment string")


def chunk_ticket(fields: DataFrame, most: int = 500) -> DataFrame:
    """(ticket, chunk_index, section_title, display_text, original_segment): a chunk for each
    field (ticket, ordinal, field, text) that isn't empty, in order, cut if longer than
    ``most`` tokens and never merged; key and field stand before each text, and numbered
    comments share the title Comment."""
    rows = fields.where("text != ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*row[:3], i, part) for row in batch.itertuples(index=False) for i, part in enumerate(pieces(row[3], most * CHARS_PER_TOKEN))]
            yield pd.DataFrame(out, columns=["ticket", "ordinal", "field", "nth", "part"])

    kind = dict(fields.dtypes)
    parts = rows.select("ticket", "ordinal", "field", "text").mapInPandas(run, f"ticket {kind['ticket']}, ordinal {kind['ordinal']}, field string, nth int, part string")
    index = F.row_number().over(Window.partitionBy("ticket").orderBy("ordinal", "field", "nth")) - 1
    title = F.when(F.col("field").rlike(r"(?i)^\s*comment\s*\d*\s*$"), "Comment").otherwise(F.col("field"))
    head = F.concat_ws(" — ", F.col("ticket").cast("string"), "field")
    return parts.select("ticket", index.alias("chunk_index"), title.alias("section_title"), F.concat(head, F.lit("\n\n"), "part").alias("display_text"), F.col("part").alias("original_segment"))


_ENDPOINT = re.compile(r"#{2,4}\s+`?(GET|POST|PUT|PATCH|DELETE)\b")


def api_chunks(text: str, most: int) -> list[tuple[str, str]]:
    """(title, text) of a generated API document: one for each endpoint heading, with the
    schemas that it refers to added while they fit, and the rest by sections."""
    parts = sections(text)
    schemas = {title.strip("`"): body for path, title, body in parts if "schema" in path.lower() and title}
    out = []
    for _, title, body in parts:
        if _ENDPOINT.match(body):
            for name in sorted(schemas):
                if re.search(rf"\b{re.escape(name)}\b", body) and len(body) + len(schemas[name]) <= most:
                    body += schemas[name]
        out += [(title, part) for part in pieces(body, most)]
    return out


def chunk_api_doc(docs: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, chunk_index, section_title, display_text) of generated API documents (doc_id,
    text): the fields of front matter (between lines of three dashes) stand before each
    chunk; see ``api_chunks``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                met = re.match(r"---\n(.*?)\n---\n", text or "", re.S)
                front = "; ".join(x.strip() for x in met[1].split("\n") if ":" in x) + "\n\n" if met else ""
                rows += [(doc_id, i, title, front + part) for i, (title, part) in enumerate(api_chunks((text or "")[met.end() if met else 0 :], most * CHARS_PER_TOKEN))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_title", "display_text"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_index int, section_title string, display_text string")


def service_doc_chunks(docs: DataFrame, most: int = 500, least: int = 200, endpoint_most: int = 800) -> DataFrame:
    """(doc_id, chunk_index, section_title, display_text, original_segment) of generated documents
    of services (doc_id, text): see ``service_docs.parts``; sizes are in tokens of four
    characters.  The front matter's service_id, aliases, domain, doc_type and summary stand
    before each chunk, with its section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                told, body = sd.front_matter(text or "")
                aka = told.get("aliases") or []
                aka = [aka] if isinstance(aka, str) else aka
                head = " | ".join([str(told.get("service_id", "")), *(["aka " + ", ".join(aka[: sd.ALIASES])] if aka else []), str(told.get("domain") or "unknown")])
                size = CHARS_PER_TOKEN
                for i, (section, part) in enumerate(sd.parts(body, most * size, least * size, endpoint_most * size, pieces)):
                    summary = f"{told['summary']}\n" if told.get("summary") else ""
                    rows.append((doc_id, i, section, f"[{head}] {told.get('doc_type', '')} › {section}\n{summary}\n{part}", part))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_title", "display_text", "original_segment"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_index int, section_title string, display_text string, original_segment string")
