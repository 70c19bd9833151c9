"""The seven verbs of a document library, as queries over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.functions.ident import SEGMENTATION
from quire.operators import lexical, locate, paging, streams, tree
from quire.sources import files, router
from quire.streaming import cursors

from .store import Store
from .telemetry import observed


class NotFound(LookupError):
    """A document, section or anchor that isn't there."""


class InvalidRequest(ValueError):
    """Arguments that contradict each other or exceed a bound."""


class IndexFailed(RuntimeError):
    """What the index says doesn't agree with the stored document."""


class Library:
    def __init__(self, spark: SparkSession, store: Store, roots: list[str]):
        self.spark, self.store, self.roots = spark, store, roots

    def list_documents(self, path: str | None = None, recursive: bool = True, max_results: int = 100) -> DataFrame:
        return files.list_documents(self.spark, self.roots, path, recursive, max_results)

    def open_document(self, path: str, force_refresh: bool = False) -> DataFrame:
        """Parse and index what lies at path, unless it is stored already; its rows of documents."""
        with observed("open", path=path):
            resources = files.read(self.spark, self.roots, path)
            fresh = resources
            if self.store._exists("documents") and not force_refresh:
                known = self.store.table("documents").select("source", "content_hash")
                fresh = resources.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("bytes", 256))).join(known, ["source", "content_hash"], "left_anti")
            self.store.put(router.parse(fresh))
        return self.store.table("documents").join(resources.select("source"), "source", "left_semi")

    def get_document_structure(self, document_id: str, max_depth: int | None = None) -> DataFrame:
        return tree.outline(self._sections(document_id), max_depth)

    def _sections(self, document_id: str) -> DataFrame:
        found = self.store.table("sections", document_id)
        if found.isEmpty():
            raise NotFound(document_id)
        return found

    def _document(self, document_id: str):
        row = self.store.table("documents", document_id).first()
        if row is None:
            raise NotFound(document_id)
        return row

    def search_document(self, document_id: str, query: str, limit: int = 10, rank: str = "bm25") -> DataFrame:
        """Units of one document that hold all tokens of the query, best first, each with its source, location
        and locator; rank is bm25 (scores by counts over the whole store), phrase or sections (whole
        sections only). A document without an index is indexed first; hits that don't agree with the stored
        document are an error."""
        if not 1 <= limit <= 50 or not query.strip():
            raise InvalidRequest("a query needs words, and a limit from 1 to 50")
        if rank not in ("bm25", "phrase", "sections"):
            raise InvalidRequest(rank)
        with observed("search", characters=len(query)):
            self.store.ensure()
            q = self.spark.createDataFrame([(0, query.strip())], "query_id int, query string")
            own = self.store.table("lexical_units", document_id)
            secs = self.store.table("sections", document_id).select("document_id", "section_id", "title", "native_location", "dfs_order", "content")
            if rank == "sections":
                ranked = lexical.rank_phrase(lexical.section_units(secs), q, limit)
            elif rank == "phrase":
                ranked = lexical.rank_phrase(own, q, limit)
            else:
                ranked = lexical.rank_bm25(own, q, limit, whole=self.store.table("lexical_units"))
            return self._hits(document_id, ranked, secs)

    def _hits(self, document_id: str, ranked: DataFrame, secs: DataFrame) -> DataFrame:
        docs = self.store.table("documents", document_id).select("document_id", "source", "content_hash", "normalized_hash")
        at = ranked.join(docs, "document_id").join(secs.select("section_id", "title", "native_location"), "section_id")
        unit = F.col("kind") != "section"
        at = at.withColumn("segmentation", F.when(unit, SEGMENTATION)).withColumn("location", lexical.location(F.col("native_location"), F.col("kind"), F.col("paragraph_index"), F.col("sentence_index")))
        names = [x.split()[0] for x in self.LOCATOR.split(", ")]
        at = at.withColumn("candidate_kind", F.col("kind")).withColumn("locator", F.struct(*names)).drop("kind")
        tables = [self.store.table(n, document_id) for n in ("documents", "sections", "paragraphs", "sentences")]
        checked = locate.resolve(at, *tables)
        rows = checked.select("rank", "section_id", "title", "source", "candidate_kind", "paragraph_index", "sentence_index", "snippet", "score", "location", "locator", "verdict", F.col("kind").alias("resolved")).orderBy("rank").collect()  # 50 at most
        for r in rows:
            if r.verdict != "ok" or r.resolved != r.candidate_kind:
                raise IndexFailed(f"hit {r.rank} is {r.verdict}: {r.candidate_kind} resolves to {r.resolved}")
        return self.spark.createDataFrame([r[:11] for r in rows], f"rank int, section_id string, title string, source string, kind string, paragraph_index int, sentence_index int, snippet string, score double, location string, locator struct<{', '.join(': '.join(x.split()) for x in self.LOCATOR.split(', '))}>")

    def _stream(self, document_id: str, section_id: str, kind: str, policy: str, labels: tuple[str, str, str] = streams.READING) -> DataFrame:
        own = [self.store.table(n, document_id).where(F.col("section_id") == section_id) for n in ("paragraphs", "sentences")]
        return streams.stream(*own, kind, policy, labels)

    def get_text_units(self, document_id: str, section_id: str, kind: str = "sentence", direction: str = "forward", policy: str = "preserve_source", max_items: int = 32, max_chars: int = 32_768, cursor: str | None = None, anchor: dict | None = None) -> dict:
        """A page of a section's stream, from its start (or end), from a cursor, or beyond an anchor, which is
        a locator of one of its items; what lies below the section isn't part of it. A traversal that began
        at an anchor never says that the section is complete."""
        paging.check_page(max_items, max_chars)
        if kind not in streams.KINDS or policy not in streams.POLICIES or direction not in streams.DIRECTIONS:
            raise InvalidRequest("kind, policy or direction")
        if cursor and anchor:
            raise InvalidRequest("an anchor or a cursor, not both")
        doc = self._document(document_id)
        section = self._sections(document_id).where(F.col("section_id") == section_id)
        if section.isEmpty():
            raise NotFound(section_id)
        scope = {"document": document_id, "section": section_id, "kind": kind, "direction": direction, "policy": policy, "segmentation": SEGMENTATION, "content_hash": doc["content_hash"], "normalized_hash": doc["normalized_hash"]}
        items = self._stream(document_id, section_id, kind, policy)
        total, forward, anchored = items.count(), direction == "forward", False
        at = 0 if forward else total
        if cursor:
            claims = cursors.decode(cursors.UNITS, cursor, scope | {"total": total})
            at, anchored = claims["position"], claims["anchored"]
            if not (isinstance(at, int) and 0 <= at <= total):
                raise InvalidRequest("the cursor lies outside of the stream")
        if anchor:
            at, anchored = self._anchor(document_id, section_id, items, anchor) + forward, True
        got = paging.page(items, [], F.lit(at), max_items, max_chars, forward).orderBy("index").collect()  # 256 at most
        left = total - at if forward else at
        if left and not got:
            raise InvalidRequest("the next item doesn't fit into max_chars")
        to = at + len(got) if forward else at - len(got)
        complete = to >= total if forward else to <= 0
        own = [self.store.table(n, document_id).where(F.col("section_id") == section_id) for n in ("paragraphs", "sentences")]
        covered = streams.coverage(section, *own, kind, policy).drop(*streams.KEY).first().asDict()
        made = [self._item(doc, section_id, r) for r in got]
        return {
            "items": made, "complete": complete, "section_complete": complete and not anchored and covered["source_complete"], "total": total, "coverage": covered,
            "next_cursor": None if complete else cursors.encode(cursors.UNITS, scope | {"total": total, "position": to, "anchored": anchored}),
        }

    def _anchor(self, document_id: str, section_id: str, items: DataFrame, locator: dict) -> int:
        """The place in a stream of the item that a locator addresses."""
        found = self._resolve(document_id, locator)
        if found["section_id"] != section_id:
            raise InvalidRequest(f"the anchor belongs to section {found['section_id']}")
        same = F.col("paragraph_index").eqNullSafe(F.lit(found["paragraph_index"]).cast("int")) & F.col("sentence_index").eqNullSafe(F.lit(found["sentence_index"]).cast("int"))
        row = items.where(same).select("index").first()
        if row is None:
            raise InvalidRequest("the anchor is no item of this stream")
        return row["index"]

    @staticmethod
    def _locator(doc: Row, section_id: str, r: Row | None) -> dict:
        own = r.asDict() if r is not None else {}
        unit = {k: own.get(k) for k in ("paragraph_index", "sentence_index", "range_start", "range_end")}
        return {"document_id": doc["document_id"], "content_hash": doc["content_hash"], "normalized_hash": doc["normalized_hash"], "section_id": section_id, **unit, "segmentation": SEGMENTATION if unit["paragraph_index"] is not None else None}

    def _item(self, doc: Row, section_id: str, r: Row) -> dict:
        coarse = "non_prose" if r["content_class"] in streams.NON_PROSE else "unknown"
        return {"text": r["text"], "locator": self._locator(doc, section_id, r), "effective_kind": r["effective_kind"], "content_class": coarse, "detail": r["content_class"], "degradation": r["degradation"]}

    def read_document(self, document_id: str, section_id: str | None = None, locator: dict | None = None, max_chars: int | None = None, cursor: str | None = None) -> dict:
        """A page of a section with all below it as Markdown, or of exactly what a locator addresses."""
        if (section_id is None) == (locator is None):
            raise InvalidRequest("name a section or a locator")
        doc = self._document(document_id)
        if section_id is not None:
            top = self.spark.createDataFrame([(document_id, section_id)], "document_id string, section_id string")
            row = tree.render(self._sections(document_id), top).first()
            if row is None:
                raise NotFound(section_id)
            whole, target = row["content"], {"section": section_id}
        else:
            whole, target = self._resolve(document_id, locator)["text"], {"locator": locator}
        limit = paging.response_limit(max_chars)
        scope = {"document": document_id, "content_hash": doc["content_hash"], "normalized_hash": doc["normalized_hash"], "target": target, "total": len(whole)}
        at = cursors.decode(cursors.READ, cursor, scope)["position"] if cursor else 0
        if cursor and limit == 0:
            raise InvalidRequest("a continued read needs max_chars")
        end = min(len(whole), at + limit)
        more = end < len(whole)
        return {"content": whole[at:end], "start": at, "end": end, "total": len(whole), "complete": not more, "next_cursor": cursors.encode(cursors.READ, scope | {"position": end}) if more else None}

    LOCATOR = "document_id string, content_hash string, normalized_hash string, section_id string, paragraph_index int, sentence_index int, range_start long, range_end long, segmentation string"

    def _resolve(self, document_id: str, locator: dict):
        names = [x.split()[0] for x in self.LOCATOR.split(", ")]
        at = self.spark.createDataFrame([tuple(locator.get(n) for n in names)], self.LOCATOR)
        t = {n: self.store.table(n, document_id) for n in ("documents", "sections", "paragraphs", "sentences")}
        resolved = locate.resolve(at, *t.values())
        verdict = resolved.first()["verdict"]
        if verdict != "ok":
            raise InvalidRequest(f"the locator is {verdict}")
        return locate.exact_text(resolved, t["sections"]).first()

    def get_context(self, document_id: str, section_id: str | None = None, relation: str = "neighbor", before: int = 1, after: int = 1, unit: str = "section", locator: dict | None = None, max_chars: int | None = None) -> dict:
        """What lies around a section or a locator. relation: neighbor (by unit section, paragraph or
        sentence; the anchor must be of that kind), container (by unit paragraph or section), owner_section,
        ancestors, siblings or children. Items have their role, locator, title or content; sections' text is
        in `content` and may be cut, items are never cut but refused."""
        if (section_id is None) == (locator is None):
            raise InvalidRequest("name a section or a locator")
        if not (0 <= before <= 20 and 0 <= after <= 20):
            raise InvalidRequest("a window has at most 20 on each side")
        doc, s = self._document(document_id), self._sections(document_id)
        found = self._resolve(document_id, locator) if locator else None
        kind = found["kind"] if found else "section"
        owner = found["section_id"] if found else section_id
        if kind == "character_range":
            raise InvalidRequest("a range of characters has no context")
        if s.where(F.col("section_id") == owner).isEmpty():
            raise NotFound(owner)
        limit = paging.response_limit(max_chars)
        if relation == "neighbor":
            if unit != kind:
                raise InvalidRequest(f"{unit} neighbours of a {kind}")
            if unit == "section":
                got = tree.neighbours(s, before, after).where(F.col("anchor_id") == owner).orderBy("offset").collect()  # 41 at most
                return self._sections_of(doc, got, limit, [r["role"] for r in got])
            return self._around(doc, owner, unit, found, before, after, limit)
        if relation == "container":
            if unit == "section":
                return self._sections_of(doc, s.where(F.col("section_id") == owner).collect(), limit, ["container"])
            if unit != "paragraph" or kind == "section":
                raise InvalidRequest("a paragraph contains paragraphs and sentences only")
            paras = self._stream(document_id, owner, "paragraph", "preserve_source").where(F.col("paragraph_index") == found["paragraph_index"])
            return self._units(doc, owner, paras.collect(), ["container"], limit)
        pick = {
            "owner_section": lambda: s.where(F.col("section_id") == owner).select(F.col("section_id").alias("id"), F.lit(0).alias("at")),
            "ancestors": lambda: tree.ancestors(s).where(F.col("section_id") == owner).select(F.col("ancestor_id").alias("id"), F.col("position").alias("at")),
            "children": lambda: tree.children(s).where(F.col("section_id") == owner).select(F.col("child_id").alias("id"), F.col("dfs_order").alias("at")),
            "siblings": lambda: tree.siblings(s).where(F.col("section_id") == owner).select(F.col("sibling_id").alias("id"), F.col("sibling_order").alias("at")),
        }
        if relation not in pick:
            raise InvalidRequest(relation)
        rows = pick[relation]().join(s.select(F.col("section_id").alias("id"), "title"), "id").orderBy("at").limit(101).collect()
        if len(rows) > 100:
            raise InvalidRequest("more than 100 items")
        if len("\n".join(r["title"] for r in rows)) > limit:
            raise InvalidRequest("the titles don't fit into max_chars")
        items = [{"title": r["title"], "content": None, "locator": self._locator(doc, r["id"], None), "role": "structural", "effective_kind": "section", "content_class": None, "degradation": None} for r in rows]
        return {"content": "", "truncated": False, "complete": True, "items": items}

    def _sections_of(self, doc: Row, rows: list[Row], limit: int, roles: list[str]) -> dict:
        """Sections without what lies below them, as one text that may be cut."""
        whole = "\n\n".join(tree.shallow(r["level"], r["title"], r["content"]) for r in rows)
        items = [{"title": r["title"], "content": None, "locator": self._locator(doc, r["section_id"], None), "role": role, "effective_kind": "section", "content_class": None, "degradation": None} for r, role in zip(rows, roles, strict=True)]
        return {"content": whole[:limit], "truncated": len(whole) > limit, "complete": len(whole) <= limit, "items": items}

    def _around(self, doc: Row, owner: str, unit: str, found: Row, before: int, after: int, limit: int) -> dict:
        items = self._stream(doc["document_id"], owner, unit, "preserve_source", streams.CONTEXT)
        same = F.col("anchor_paragraph_index").eqNullSafe(F.lit(found["paragraph_index"])) & F.col("anchor_sentence_index").eqNullSafe(F.lit(found["sentence_index"]).cast("int"))
        rows = streams.neighbours(items, before, after).where(same).orderBy("offset").collect()  # 41 at most
        return self._units(doc, owner, rows, [r["role"] for r in rows], limit)

    def _units(self, doc: Row, owner: str, rows: list[Row], roles: list[str], limit: int) -> dict:
        if sum(len(r["text"]) for r in rows) + 2 * max(0, len(rows) - 1) > limit:
            raise InvalidRequest("the items don't fit into max_chars")
        items = [{"title": None, "content": r["text"], "locator": self._locator(doc, owner, r), "role": role, "effective_kind": r["effective_kind"], "content_class": r["content_class"], "degradation": r["degradation"]} for r, role in zip(rows, roles, strict=True)]
        return {"content": "", "truncated": False, "complete": True, "items": items}
