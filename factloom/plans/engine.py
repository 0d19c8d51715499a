"""The engine's interface: what a caller can ask for, each a function of a scope and the office's relations.

Relations are DataFrames by name:

documents (document_id, office_id, group_id, title, deleted_at), document_versions (version_id, document_id, office_id,
version_no, is_current, status, pages_incomplete), occurrences (occurrence_id, version_id, document_id, office_id,
transaction_id, data_kind, city, neighborhood, property_type, area_type, vat_basis, transaction_date, valuation_date,
report_date, price, area, stated, verification_status, page_no, row_index), transactions (transaction_id, office_id,
price, area, area_type), chunks (chunk_id, version_id, document_id, office_id, text, normalized_text, embedding,
embedding_model), dedup_candidates (a, b, status, reason, office_id), user_groups (user_id, group_id).
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import TenantContext, secure, secure_content, secure_documents, still_authorized
from ..functions.numbers import price_conflict, price_per_area
from ..functions.text import normalize_for_search, numbers_in, substring_filter
from ..operators import identity, retrieval, stats
from ..operators.index import SearchIndex
from ..rounds import checkpointed, scratch_folder
from .batch import CONDITIONS, KeptAnswers, answer_questions
from .conditions import AWAITING, VERIFIED, Conditions, open_points, predicate
from .question import Reading, read_questions, reading_of

# Labels of answers, and the order in which mixed attributes are asked about.
KIND_LABELS = {"transaction_price": "מחירי עסקאות", "appraised_value": "שווי שנקבע בשומות", "asking_price": "מחירים מבוקשים", "adjusted_comparable": "נתוני השוואה מתואמים"}
DATE_LABELS = {"transaction_date": "תאריך העסקה", "valuation_date": "המועד הקובע של השומה", "report_date": "תאריך עריכת השומה"}
AREA_LABELS = {"net": "נטו", "gross": "ברוטו", "registered": "רשום", "equivalent": "אקוויוולנטי", "other": "אחר"}
MIXED = ("area_type", "property_type", "vat_basis")
MEDIAN_FROM = 3
#: Sources that an answer lists itself; source_table has all of them.
LISTED = 200
#: Answers that an engine keeps; the one longest unused goes first.
KEPT = 1000


@dataclass
class Answer:
    outcome: str  # numeric, content, combined, clarification, abstain
    text: str = ""
    conditions: Conditions | None = None
    numbers: dict = field(default_factory=dict)
    ask: str | None = None
    options: list = field(default_factory=list)
    sources: list = field(default_factory=list)
    limitations: list = field(default_factory=list)
    cacheable: bool = True
    provider: str = "extractive"
    cited: DataFrame | None = None  # (version_id) every version that the answer rests on, listed or not
    source_table: DataFrame | None = None  # every source of a numeric answer


def shown(value) -> str:
    """Grouped digits, cents only where there are any."""
    if value is None:
        return "—"
    v = Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return f"{v:,.0f}" if v == v.to_integral_value() else f"{v:,.2f}"


def describe(c: Conditions) -> list[tuple[str, str]]:
    """The conditions that rule an answer, as label and value."""
    out = [("kind", KIND_LABELS[c.data_kind])] if c.data_kind else []
    out += [(name, getattr(c, name)) for name in ("city", "neighborhood", "property_type", "vat_basis") if getattr(c, name)]
    if c.area_type:
        out.append(("area_type", AREA_LABELS[c.area_type]))
    if c.date_field and (years := c.years()):
        out.append((DATE_LABELS[c.date_field], " <= x < ".join(f"01/01/{y}" for y in years)))
    return out


def numeric_text(c: Conditions, n: dict, uncertain: int, conflicts: int) -> tuple[str, list[str]]:
    """An answer's sentences and its limitations, from the computed numbers alone."""
    scope = ", ".join(v for _, v in describe(c))
    lines = [f"{scope}: {n['n']} רשומות ייחודיות.", f"ממוצע: {shown(n['mean'])} ₪ למ״ר.", f"משוקלל: {shown(n['weighted'])} ₪ למ״ר."]
    if n["n"] >= MEDIAN_FROM:
        lines.append(f"חציון: {shown(n['median'])} ₪ למ״ר, טווח {shown(n['least'])}–{shown(n['most'])}.")
    limits = ["verified records of this office only", "no adjustments"]
    limits += [f"{uncertain} undecided pairs were counted apart"] if uncertain else []
    limits += [f"{conflicts} records state another price per area than computed"] if conflicts else []
    return "\n".join(lines), limits


def merge_filters(c: Conditions, chosen: dict) -> tuple[Conditions, list[str]]:
    """Conditions with the reader's chosen filters, and the names of those that contradict the question."""
    against = [k for k, v in chosen.items() if v is not None and getattr(c, k) not in (None, v)]
    return c.with_changes(**{k: v for k, v in chosen.items() if v is not None and k not in against}), against


def choose_provider(enabled: bool, key: str | None, demo: bool) -> str:
    """Who writes content answers: a model service, the demo, or the evidence itself."""
    if enabled:
        return "cloud" if key else "enabled_no_key"
    return "demo" if demo else "extractive"


class Engine:
    """One office's relations under the callers' scopes, with versioned answers kept by exact key."""

    def __init__(
        self,
        relations: dict[str, DataFrame],
        data_version: int = 0,
        embed: Callable[[str], list[float]] | None = None,
        model: str | None = None,
        writer: Callable[[str, list[dict]], tuple[str, list[str]]] | None = None,
        index: SearchIndex | None = None,
    ):
        """embed makes a question's vector under model; writer makes a text and the evidence ids it used from a question and its evidence.

        index is what searches read; without one it is built from the chunks when first asked for.
        """
        self.relations, self.data_version, self.embed, self.model, self.writer = relations, data_version, embed, model, writer
        self.index = index
        self.cache: OrderedDict[str, Answer] = OrderedDict()

    # scoped relations

    def visible_documents(self, ctx: TenantContext) -> DataFrame:
        return secure_documents(self.relations["documents"], self.relations["user_groups"], ctx)

    def visible(self, name: str, ctx: TenantContext) -> DataFrame:
        return secure_content(self.relations[name], self.visible_documents(ctx), ctx)

    def records(self, ctx: TenantContext) -> DataFrame:
        """Visible occurrences with their version's and document's state and their fact's agreed values."""
        docs = self.visible_documents(ctx).select("document_id", "deleted_at", "title")
        current = self.relations["document_versions"].select("version_id", "is_current")
        agreed = secure(self.relations["transactions"], ctx).select("transaction_id", F.col("price").alias("fact_price"), F.col("area").alias("fact_area"), F.col("area_type").alias("fact_area_type"))
        return secure(self.relations["occurrences"], ctx).join(current, "version_id").join(docs, "document_id").join(agreed, "transaction_id")

    def places(self, ctx: TenantContext) -> DataFrame:
        """Names of places in the office's records."""
        return self.visible("occurrences", ctx).where("verification_status != 'rejected'").select("city", "neighborhood").distinct()

    def read(self, ctx: TenantContext, question: str, previous: Conditions | None = None, known: tuple[str, ...] = ()) -> Reading:
        """One question, after the conditions that its conversation stands at."""
        spark = self.relations["documents"].sparkSession
        asked = spark.createDataFrame([(0, 0, question)], "conversation_id int, turn int, question string")
        names = spark.createDataFrame([(c,) for c in known], "city string") if known else None
        shape = "conversation_id int, " + ", ".join(f"{n} {'int' if n.startswith('year') else 'string'}" for n in asdict(Conditions()))
        carried = None if previous is None else spark.createDataFrame([(0, *asdict(previous).values())], shape)
        return reading_of(read_questions(asked, self.places(ctx), names, carried).first())

    # questions

    def ask(self, ctx: TenantContext, question: str, previous: Conditions | None = None, filters: dict | None = None, known: tuple[str, ...] = ()) -> Answer:
        reading = self.read(ctx, question, previous, known)
        if reading.unknown_place:
            return Answer("abstain", f"אין נתונים על {reading.unknown_place}", reading.conditions, cacheable=False)
        c, against = merge_filters(reading.conditions, filters or {})
        if against:
            return Answer("clarification", conditions=c, ask=against[0], options=[getattr(c, against[0]), filters[against[0]]])
        return self.answer(ctx, reading, c, question)

    def answer(self, ctx: TenantContext, reading: Reading, c: Conditions, question: str) -> Answer:
        if asked := open_points(c):
            return Answer("clarification", conditions=c, ask=asked[0], options=list(KIND_LABELS if asked[0] == "data_kind" else DATE_LABELS))
        if c.intent in ("explanation", "document_lookup"):
            return self.content(ctx, question, c)
        groups = hashlib.sha256("|".join(sorted(ctx.groups)).encode()).hexdigest()
        key = c.cache_key(office=ctx.office_id, user=ctx.user_id, role=ctx.role, groups=groups, version=self.data_version, question=question if c.intent == "combined" else None)
        if key not in self.cache or not self.authorized(ctx, self.cache[key]):
            out = self.numeric(ctx, c)
            if c.intent == "combined" and out.outcome == "numeric":
                text = self.content(ctx, " ".join(x for x in (question, c.city, c.neighborhood) if x), c)
                out = Answer("combined", f"{out.text}\n{text.text}", c, out.numbers, sources=out.sources + text.sources, limitations=out.limitations + text.limitations, cacheable=text.cacheable, provider=text.provider, cited=out.cited if text.cited is None else checkpointed(out.cited.unionByName(text.cited).distinct()), source_table=out.source_table)
            if not out.cacheable:
                self.cache.pop(key, None)
                return out
            self.cache[key] = out
            if len(self.cache) > KEPT:
                self.cache.popitem(last=False)
        self.cache.move_to_end(key)
        return self.cache[key]

    def authorized(self, ctx: TenantContext, answer: Answer) -> bool:
        """Whether every version that a kept answer cites is still visible, current and not deleted."""
        if answer.cited is None:
            return True
        seen = self.visible_versions(ctx).withColumn("version_id", F.col("version_id").cast("string"))
        cited = answer.cited.select(F.lit(0).alias("answer_id"), F.col("version_id").cast("string").alias("version_id"))
        found = still_authorized(cited, seen).first()
        return found is None or found["authorized"]

    def numeric(self, ctx: TenantContext, c: Conditions) -> Answer:
        rows = self.records(ctx)
        matched = rows.where(predicate(c, VERIFIED, "fact_area_type"))
        for name in MIXED:  # in this order, one question at a time
            if getattr(c, name) is None:
                column = "fact_area_type" if name == "area_type" else name
                values = stats.distinct_values(matched, column, ["transaction_id"]).collect()  # one row per kind
                if len(values) > 1:
                    return Answer("clarification", conditions=c, ask=name, options=[(r["value"], r["n"]) for r in values])
        facts = matched.select("transaction_id", F.col("fact_price").alias("price"), F.col("fact_area").alias("area")).distinct()
        numbers = stats.statistics(facts).first().asDict()
        waiting = stats.coverage_gap(rows, predicate(c, VERIFIED, "fact_area_type"), predicate(c, AWAITING, "fact_area_type"), ["transaction_id"]).count()
        if not numbers["n"]:
            return Answer("abstain", f"לא נמצאו רשומות מאומתות; ממתינות: {waiting}", c, {"awaiting": waiting})
        own = matched.select("transaction_id").distinct()
        pairs = self.relations["dedup_candidates"].where("status = 'open'")
        uncertain = identity.both_ends(secure(pairs, ctx), own, "transaction_id").count()
        current = rows.where("is_current AND deleted_at IS NULL").join(own, "transaction_id", "left_semi")
        conflicts = stats.conflict_count(current, price_conflict(F.col("stated"), price_per_area(F.col("price"), F.col("area"))), ["transaction_id"]).first()[0]
        if numbers["n"] < MEDIAN_FROM:
            numbers["median"] = None
        text, limits = numeric_text(c, numbers, uncertain, conflicts)
        every = current.select("title", "page_no", "row_index", "transaction_id", "document_id", "version_id")
        sources, total = every.orderBy("title", "page_no", "row_index", "transaction_id").limit(LISTED).collect(), every.count()
        if total > LISTED:
            limits.append(f"{LISTED} of {total} sources are listed")
        listed = [{"source_id": f"S{i + 1}", **r.asDict()} for i, r in enumerate(sources)]
        cited = checkpointed(every.select("version_id").distinct())
        return Answer("numeric", text, c, {**numbers, "awaiting": waiting}, sources=listed, limitations=limits, cited=cited, source_table=every)

    def answer_table(self, ctx: TenantContext, questions: DataFrame, kept: KeptAnswers | None = None, batch: str | None = None) -> DataFrame:
        """The numeric answers of many questions (question_id and the columns of Conditions), computed together.

        With kept, answers that still hold for this caller are taken from there and the others are put there under the batch's name.
        """
        pairs = secure(self.relations["dedup_candidates"].where("status = 'open'"), ctx).select("a", "b")
        if kept is None:
            return answer_questions(questions, self.records(ctx), pairs)[0]
        who = F.lit("|".join([str(ctx.office_id), str(ctx.user_id), ctx.role, *sorted(ctx.groups)]))
        stated = F.to_json(F.struct(*(F.coalesce(F.col(n).cast("string"), F.lit("\0")).alias(n) for n in CONDITIONS)))
        keyed = checkpointed(questions.withColumn("key", F.sha2(F.concat_ws("\n", who, F.lit(str(self.data_version)), stated), 256)))
        held = checkpointed(kept.serve(keyed, self.visible_versions(ctx), self.data_version))
        new = keyed.join(held, "key", "left_anti")
        answers, cited = answer_questions(new.select(F.col("key").alias("question_id"), *CONDITIONS).distinct(), self.records(ctx), pairs)
        shape = answers.drop("question_id").schema
        rows = checkpointed(answers.select(F.col("question_id").alias("key"), F.lit(self.data_version).cast("long").alias("data_version"), F.to_json(F.struct(*shape.names), {"ignoreNullFields": "false"}).alias("answer")))
        kept.put(batch or f"answers-{uuid.uuid4().hex}", rows, cited.withColumnRenamed("question_id", "key"))
        every = held.unionByName(rows.select("key", "answer"))
        return keyed.select("question_id", "key").join(every, "key").select("question_id", F.from_json("answer", shape).alias("a")).select("question_id", "a.*")

    def content(self, ctx: TenantContext, question: str, c: Conditions | None = None) -> Answer:
        """The writer's answer if it stands up to its evidence, else the best supported sentences, each with its citation."""
        hits = self.search(ctx, question, 12)
        found = retrieval.evidence(hits)
        evidence = found.select("evidence_id", "document_id", "version_id", "chunk_id", "text").collect()
        if not evidence:
            return Answer("abstain", "אין בסיס מספיק במסמכים", c)
        sources, cited = [r.asDict() for r in evidence], found.select("version_id").sparkSession.createDataFrame(sorted({(r.version_id,) for r in evidence}), found.select("version_id").schema)
        limits, cacheable = [], True
        if self.writer is not None:
            try:
                text, used = self.writer(question, sources)
            except Exception as failure:  # whatever a service throws, the evidence still answers
                limits, cacheable = [f"the writer failed: {type(failure).__name__}"], False
            else:
                problems = self.problems(text, used, evidence)
                if not problems:
                    return Answer("content", text, c, sources=sources, provider="writer", cited=cited)
                limits = ["the writer's text was rejected: " + ", ".join(problems)]
        picked = retrieval.best_sentences(found, self._terms(question)).collect()
        text = " ".join(f"{r.sentence} [{r.evidence_id}]" for r in picked) or f"{evidence[0].text[:280]} [{evidence[0].evidence_id}]"
        return Answer("content", text, c, sources=sources, limitations=limits, cacheable=cacheable, cited=cited)

    def problems(self, text: str, used: list[str], evidence: list) -> list[str]:
        """What speaks against a written answer: markup, citations and numbers that the evidence doesn't bear."""
        spark = self.relations["documents"].sparkSession
        row = spark.createDataFrame([(text, used, [r.evidence_id for r in evidence], "\n".join(r.text for r in evidence))], "text string, used array<string>, allowed_ids array<string>, basis string")
        return retrieval.verify(row.withColumn("allowed_numbers", numbers_in(F.col("basis")))).first()["problems"]

    def _terms(self, question: str) -> list[str]:
        from ..functions.text import query_tokens

        any_relation = self.relations["documents"]
        return any_relation.sparkSession.range(1).select(query_tokens(F.lit(question)).alias("t")).first()["t"]

    def visible_versions(self, ctx: TenantContext) -> DataFrame:
        """(version_id) of current versions of documents that the caller sees and that aren't deleted."""
        live = self.visible_documents(ctx).where("deleted_at IS NULL").select("document_id")
        return secure(self.relations["document_versions"], ctx).where("is_current").join(live, "document_id", "left_semi").select("version_id")

    def search_index(self) -> SearchIndex:
        if self.index is None:
            chunks = self.relations["chunks"]
            self.index = SearchIndex(chunks.sparkSession, scratch_folder(chunks.sparkSession, "search"), chunks.schema["chunk_id"].dataType.simpleString())
            self.index.apply(f"built-{self.data_version}", chunks)
        return self.index

    def search(self, ctx: TenantContext, question: str, most: int = 8) -> DataFrame:
        """Hybrid search over the chunks of current versions of visible documents; texts are read only of what is found."""
        index, visible = self.search_index(), checkpointed(self.visible_versions(ctx))
        terms = self._terms(question)
        # Numbers are looked for exactly only; without other terms there is nothing to look for by likeness.
        lists = {"lexical": index.lexical(visible, terms), "trigram": index.trigram(visible, " ".join(t for t in terms if any(x.isalpha() for x in t)))}
        if self.embed is not None:
            lists["semantic"] = index.semantic(visible, self.embed(question), self.model)
        chunks = secure(self.relations["chunks"], ctx).join(visible, "version_id", "left_semi")
        return chunks.join(F.broadcast(retrieval.fuse(lists, most)), "chunk_id").orderBy("place")

    def publish_chunks(self, batch: str, chunks: DataFrame, gone: DataFrame | None = None) -> Engine:
        """The engine after some versions' chunks are replaced and those of versions in gone (version_id) withdrawn; the index takes in only these."""
        index, own = self.search_index(), chunks.select("version_id")
        index.apply(batch, chunks, gone=gone)
        kept = self.relations["chunks"].join((own if gone is None else own.unionByName(gone.select("version_id"))).distinct(), "version_id", "left_anti")
        new = kept.unionByName(chunks.select(kept.columns))
        return Engine({**self.relations, "chunks": new}, self.data_version + 1, self.embed, self.model, self.writer, index)

    # lists and details

    def list_documents(self, ctx: TenantContext, wanted: str | None = None, status: str | None = None) -> DataFrame:
        """Visible documents with their latest version and its status, and how many versions they have."""
        best = F.max_by(F.struct("version_id", "status", "version_no"), "version_no")
        per = self.relations["document_versions"].groupBy("document_id").agg(best.alias("latest"), F.count(F.lit(1)).alias("versions"))
        docs = self.visible_documents(ctx).where("deleted_at IS NULL").join(per, "document_id", "left")
        if (test := substring_filter(F.col("title"), wanted)) is not None:
            docs = docs.where(test)
        out = docs.select("document_id", "title", F.col("latest.version_id").alias("version_id"), F.col("latest.status").alias("status"), F.coalesce("versions", F.lit(0)).alias("versions"))
        return out if status is None else out.where(F.col("status") == status)

    def review_queue(self, ctx: TenantContext) -> DataFrame:
        """Records that wait for review and undecided pairs with both ends current, in one shape."""
        rows = self.records(ctx).where("is_current AND deleted_at IS NULL")
        records = rows.where(F.col("verification_status").isin(*AWAITING)).select(F.lit("record").alias("kind"), F.col("occurrence_id").cast("string").alias("id"), F.col("verification_status").alias("detail"))
        pairs = identity.both_ends(secure(self.relations["dedup_candidates"], ctx).where("status = 'open'"), rows, "transaction_id")
        shaped = pairs.select(F.lit("pair").alias("kind"), F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"), F.col("reason").alias("detail"))
        return records.unionByName(shaped).orderBy((F.col("detail") == "needs_review").desc(), "kind", "id")

    def record_detail(self, ctx: TenantContext, occurrence_id) -> DataFrame:
        """The fields of one visible record, a row each."""
        names = ["city", "neighborhood", "property_type", "area_type", "vat_basis", "transaction_date", "valuation_date", "report_date", "price", "area", "stated"]
        own = self.records(ctx).where(F.col("occurrence_id") == F.lit(occurrence_id))
        return own.select("occurrence_id", *(F.col(n).cast("string").alias(n) for n in names)).unpivot(["occurrence_id"], names, "field", "value")

    def coverage_summary(self, ctx: TenantContext) -> DataFrame:
        """How many visible records stand in each state, in one pass."""
        ctx.require_admin()
        s = F.col("verification_status")
        return self.records(ctx).where("is_current").agg(F.count(F.lit(1)).alias("records"), F.count_if(s.isin(*VERIFIED)).alias("verified"), F.count_if(s.isin(*AWAITING)).alias("awaiting"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s == "rejected").alias("rejected"))

    def history(self, questions: DataFrame, cited: DataFrame, ctx: TenantContext) -> DataFrame:
        """Earlier answers: stale if data changed since, hidden if a cited document isn't visible any more."""
        visible = self.visible_documents(ctx).where("deleted_at IS NULL").select("document_id").withColumn("seen", F.lit(1))
        counts = cited.join(visible, "document_id", "left").groupBy("question_id").agg(F.count(F.lit(1)).alias("cited"), F.count("seen").alias("seen"))
        joined = questions.join(counts, "question_id", "left")
        return joined.select("question_id", "answer_version", (F.col("answer_version") < self.data_version).alias("stale"), (F.coalesce("seen", F.lit(0)) < F.coalesce("cited", F.lit(0))).alias("hidden"))

    def changed(self, **relations: DataFrame) -> Engine:
        """The engine after a mutation: replaced relations and the next data version, so no kept answer matches."""
        index = None if "chunks" in relations else self.index
        return Engine({**self.relations, **relations}, self.data_version + 1, self.embed, self.model, self.writer, index)

    # a reviewer's decisions

    def set_status(self, ctx: TenantContext, occurrence_id, action: str, note: str | None = None) -> Engine:
        """The engine after one record is approved or rejected; a rejection needs a note, and the record has to be visible."""
        if action == "reject" and not (note or "").strip():
            raise ValueError("a rejection needs a note")
        if self.records(ctx).where(F.col("occurrence_id") == F.lit(occurrence_id)).isEmpty():
            raise PermissionError("no such record")
        status = {"approve": "human_verified", "reject": "rejected"}[action]
        own = F.col("occurrence_id") == F.lit(occurrence_id)
        return self.changed(occurrences=self.relations["occurrences"].withColumn("verification_status", F.when(own, F.lit(status)).otherwise(F.col("verification_status"))))

    def _open_pair(self, ctx: TenantContext, a, b) -> DataFrame:
        """The open pair of two facts, if the caller sees both of them."""
        pair = secure(self.relations["dedup_candidates"], ctx).where((F.col("status") == "open") & (F.col("a") == F.lit(a)) & (F.col("b") == F.lit(b)))
        pair = identity.both_ends(pair, self.visible("occurrences", ctx), "transaction_id")
        if pair.isEmpty():
            raise PermissionError("no such pair")
        return pair

    def merge(self, ctx: TenantContext, a, b) -> Engine:
        """The engine after fact b is merged into fact a: its records and its other open pairs concern a."""
        self._open_pair(ctx, a, b)
        rows, pairs = self.relations["occurrences"], self.relations["dedup_candidates"]
        merges = rows.sparkSession.createDataFrame([(b, a)], f"loser {rows.schema['transaction_id'].dataType.simpleString()}, survivor {rows.schema['transaction_id'].dataType.simpleString()}")
        touches = (F.col("a") == F.lit(b)) | (F.col("b") == F.lit(b))
        others = pairs.where(~touches)
        moved = identity.repoint(secure(pairs, ctx).where(touches & (F.col("status") == "open")), merges)
        new = moved.join(others.select("a", "b"), ["a", "b"], "left_anti").withColumns({"status": F.lit("open"), "office_id": F.lit(ctx.office_id)})
        facts = self.relations["transactions"].where(F.col("transaction_id") != F.lit(b))
        return self.changed(occurrences=identity.apply_merges(rows, merges).select(rows.columns), dedup_candidates=others.unionByName(new.select(others.columns)), transactions=facts)

    def keep_separate(self, ctx: TenantContext, a, b) -> Engine:
        """The engine after a pair is decided to be two facts."""
        self._open_pair(ctx, a, b)
        own = (F.col("a") == F.lit(a)) & (F.col("b") == F.lit(b)) & (F.col("status") == "open")
        return self.changed(dedup_candidates=self.relations["dedup_candidates"].withColumn("status", F.when(own, F.lit("kept_separate")).otherwise(F.col("status"))))


def reindex(chunks: DataFrame) -> DataFrame:
    """Chunks with their search text derived anew."""
    return chunks.withColumn("normalized_text", normalize_for_search(F.col("text")))


def saved(answer: Answer, question_id: str, conversation_id: str, version: int) -> dict:
    """An answer as a row of the question log."""
    return {"question_id": question_id, "conversation_id": conversation_id, "outcome": answer.outcome, "text": answer.text, "conditions": asdict(answer.conditions) if answer.conditions else None, "answer_version": version}
