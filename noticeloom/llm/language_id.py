"""Language of documents: text likelihoods fused with declared language, address and host."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.llm.superkmers import chunks
from noticeloom.session import write_out

#: Cells of the table of letter groups.
CELLS = 1 << 16
#: Labelled rows for each language from which the text model is fitted, those of the least hash.
ROWS_PER_LABEL = 1000
#: A label space beyond this is not one of languages, and would make the model too large to send.
MOST_LABELS = 500
#: Letter groups of a text are not independent: ever so many count as at most this many.
FULL_WEIGHT = 60.0
#: Nats by which an average letter group is less likely in no language than in the best
#: language's own labelled rows.
MARGIN = 5.0
#: Rows of a parent that a host's own rows are weighed against.
KAPPA = 20.0
UNKNOWN = "und"

_LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def letter_groups(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all groups of three letters or word ends, whether each counts, and where each
    text starts. A group around a space says nothing and does not count."""
    own = [f"  {(t or '').lower()}  ".encode(errors="replace").translate(_LETTERS) for t in texts]
    data = np.frombuffer(b"".join(own) + b"  ", np.uint8)
    code = data[:-2].astype(np.uint32)
    code = (code << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(16)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    return cell, data[1:-1] != 32, np.cumsum(sizes) - sizes


@dataclass
class TextModel:
    """Log-likelihood of each cell in each language, and the usual one of a group of letters."""

    labels: list[str]
    table: np.ndarray
    usual: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Groups that count in each text, and their mean log-likelihood in each language."""
        cell, counts, starts = letter_groups(texts)
        n = np.add.reduceat(counts.astype(np.int64), starts)
        total = [np.add.reduceat(np.where(counts, row[cell], 0), starts, dtype=np.float64)
                 for row in self.table]
        return n, np.stack(total, 1) / np.maximum(n, 1)[:, None]


def fit_text_model(rows: DataFrame, per_label: int = ROWS_PER_LABEL) -> TextModel | None:
    """Naive Bayes over letter groups, from at most ``per_label`` rows of each label.

    ``rows`` has ``rid, text, label``. Which rows count is drawn by hash before any text moves;
    the groups are counted where the texts are. None if no row has a label.
    """
    # Of a label with many rows only those of a low hash, about four times as many as wanted, meet in
    # its window.
    marked = rows.filter("label IS NOT NULL").select(
        "rid", "label", F.shiftrightunsigned(F.xxhash64("rid"), 1).alias("draw"))
    sizes = write_out(marked.groupBy("label").agg(F.count("*").alias("rows")), "label_sizes")
    if sizes.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels are no languages")
    low = F.col("draw") / F.lit(float(1 << 63))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("draw", "rid"))
    drawn = (marked.join(sizes, "label").filter(low * F.col("rows") < 4 * per_label)
             .withColumn("turn", turn).filter(F.col("turn") <= per_label))
    # At most per_label rows of each label, so the texts stay where they are.
    sample = rows.select("rid", "text").join(F.broadcast(drawn.select("rid", "label")), "rid")

    def count(batches):
        for batch in batches:
            for part in chunks(pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(1)], ["rid", "label", "text"])):
                cell, counts, starts = letter_groups(part.column(2).to_pylist())
                ends = np.append(starts[1:], len(cell))
                labels = np.array(part.column(1).to_pylist())
                for label in np.unique(labels).tolist():
                    own = np.concatenate([cell[a:b][counts[a:b]] for a, b, x in zip(
                        starts, ends, labels, strict=True) if x == label])
                    cells, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(cells), pa.string()), pa.array(cells.astype(np.int32)),
                         pa.array(n)], ["label", "cell", "n"])

    counted = sample.mapInArrow(count, "label string, cell int, n long").groupBy("label", "cell").agg(
        F.sum("n").alias("n"))
    counted = write_out(counted, "letters")
    labels = [r.label for r in counted.select("label").distinct().collect()]
    if not labels:
        return None
    labels.sort()
    table = np.zeros((len(labels), CELLS))
    for label, cell, n in counted.toPandas().itertuples(index=False):
        table[labels.index(label), cell] = n
    share = (table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * CELLS)
    usual = (table * np.log(share)).sum(1) / np.maximum(table.sum(1), 1)
    return TextModel(labels, np.log(share).astype(np.float32), usual)


def declared_language(text: Column) -> Column:
    """The language that markup declares for the whole text, null if there is none."""
    found = F.lower(F.regexp_extract(
        text, r"(?i)<(?:html|body)\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def host_of(address: Column) -> Column:
    """The host of an address; a value without scheme is a host itself."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.trim(address), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
                                    r"[/?#:].*$", ""))
    return F.when(host != "", host)


def _suffix(host: Column) -> Column:
    found = F.regexp_extract(host, r"\.([a-z]{2,24})$", 1)
    return F.when(found != "", found)


def _domain(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def _scorer(model):
    def run(batches):
        own = model.value
        for batch in batches:
            for part in chunks(batch):
                n, mean = own.score(part.column(2).to_pylist())
                full = n / (1 + n / FULL_WEIGHT)
                top = mean.max(1)
                lead = full[:, None] * (mean - top[:, None])
                # No language is one more account of the text, the last.
                none = full * (own.usual[mean.argmax(1)] - MARGIN - top)
                p = np.column_stack([lead, none])
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[n == 0] = 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *part.columns[3:], pa.array(n),
                     pa.array(lead.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64())),
                     pa.array(top)], ["rid", "id", "host", "declared", "n", "lead", "p", "top"])
    return run


def _fuse(labels: list[str], usual: np.ndarray, total: np.ndarray):
    """The posterior of each row over the languages and, last, none; tables give sums of text
    posteriors for each key."""
    overall = (total + 1) / (total.sum() + len(total))

    def run(batches):
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}

            def wide(name, size):
                values = col[name].to_pylist()
                return np.array([v or [0.0] * size for v in values]).reshape(len(values), size)

            def sums(name):
                # A row's own text does not vouch for itself, so it is taken out of all sums.
                return np.maximum(wide(name, len(total)) - own, 0)

            own, lead = wide("p", len(total)), wide("lead", len(labels))
            domain = sums("domain_sum")
            domain = (domain + KAPPA * overall) / (domain.sum(1, keepdims=True) + KAPPA)
            host = sums("host_sum")
            score = np.log((host + KAPPA * domain) / (host.sum(1, keepdims=True) + KAPPA))
            score[:, :-1] += lead
            rest = np.maximum(total - own, 0)
            for name in ("declared", "suffix"):
                known = np.array([v is not None for v in col[name].to_pylist()])[:, None]
                seen = sums(f"{name}_sum")
                # How often rows of each language have this value, against rows of all languages.
                held, of = seen[:, :-1] + 0.5, rest[:, :-1] + 1
                if name == "declared":
                    match = np.array([[x == v for x in labels] for v in col[name].to_pylist()])
                    held, of = seen[:, :-1] + np.where(match, 4.5, 0.5), rest[:, :-1] + 5
                # Rows in no language have it as often as all others, as far as they do not say.
                usually = held.sum(1) / of.sum(1)
                chance = np.column_stack([held / of, (seen[:, -1] + KAPPA * usually) / (rest[:, -1] + KAPPA)])
                score = score + np.where(known, np.log(chance), 0)
            n = np.array(col["n"].to_pylist(), np.int64)
            best = score[:, :-1].argmax(1)
            # In no language, the text is as likely as those of the fused best one less the margin.
            full = n / (1 + n / FULL_WEIGHT)
            score[:, -1] += full * (usual[best] - MARGIN - np.array(col["top"].to_pylist()))
            # Without a letter there is no language.
            score[n == 0, :-1] = -np.inf
            posterior = np.exp(score - score.max(1, keepdims=True))
            posterior /= posterior.sum(1, keepdims=True)
            at = np.arange(len(n)), best
            accepted = score[at] > score[:, -1]
            yield pa.RecordBatch.from_arrays(
                [col["id"], pa.array([labels[b] if ok else UNKNOWN for b, ok in zip(best, accepted, strict=True)]),
                 pa.array(np.where(accepted, posterior[at], posterior[:, -1])), pa.array(accepted),
                 col["declared"], col["host"], col["n"], col["rid"]],
                ["id", "language", "confidence", "accepted", "declared", "host", "n_groups", "rid"])
    return run


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                       address: str | None = "source", label: str = "lang",
                       labelled: DataFrame | None = None, labelled_text: str = "text",
                       per_label: int = ROWS_PER_LABEL, rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``language``, ``confidence``, ``accepted``, ``declared``,
    ``host``, ``n_groups``, ``rid``.

    The text model is fitted on ``per_label`` rows of each ``label`` of ``labelled`` (``docs`` itself if
    not given). Everything else comes from all rows: sums of text posteriors for each
    declared language, address suffix, domain and host. A host's prior leans on its domain's and
    that on the overall one; declared language and suffix count by how often rows of
    each language have them. Null evidence says nothing. Without any label the
    language is ``und`` and every text with a letter is accepted.

    No language is one more class: its text likelihood is that of the best language's labelled rows
    less ``MARGIN`` a group, and host, domain, suffix and declared language count for it as for the
    others. A text for which it is likelier than the best language, or one without letters, is ``und``
    and not accepted; ``confidence`` is then that of no language. Sums are merged within tasks before they
    move, and joins have one row for a key on that side, so a hot host is split. ``rid`` names a
    column of row numbers, if ``docs`` has one.
    """
    spark = docs.sparkSession
    value = F.col(text)
    host = host_of(F.col(address)) if address else F.lit(None).cast("string")
    numbered, number = with_numbers(docs, rid)
    rows = numbered.select(F.col(number).alias("rid"), F.col(id_col).alias("id"), value.alias("text"), host.alias("host"),
                       declared_language(value).alias("declared"))
    kind = rows.schema["id"].dataType.simpleString()
    own = text if labelled is None else labelled_text
    source, key = (numbered, number) if labelled is None else with_numbers(labelled, None)
    model = fit_text_model(
        source.select(F.col(key).alias("rid"), F.col(own).alias("text"), F.col(label).alias("label")), per_label)
    if model is None:
        some = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("language"),
                           F.lit(0.0).alias("confidence"), some.alias("accepted"), "declared", "host",
                           F.lit(None).cast("long").alias("n_groups"), "rid")
    shared = spark.sparkContext.broadcast(model)
    # Groups inside markup are names of elements, not words of the language.
    plain = F.when(F.col("declared").isNull(), F.col("text")).otherwise(
        F.regexp_replace("text", r"<[^<>]*>", " "))
    scored = rows.select("rid", "id", plain.alias("text"), "host", "declared").mapInArrow(
        _scorer(shared), f"rid long, id {kind}, host string, declared string, n long, "
        "lead array<double>, p array<double>, top double")
    seen = write_out(scored, "scores").withColumns(
        {"suffix": _suffix(F.col("host")), "domain": _domain(F.col("host"))})
    sums = F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(len(model.labels) + 1)])
    total = np.array([x or 0.0 for x in seen.agg(sums.alias("t")).first()[0]])
    joined = seen
    for key in ("declared", "suffix", "domain", "host"):
        # Written, so that both sides are plain exchanges, of which Spark splits a hot key's.
        joined = joined.join(write_out(seen.filter(F.col(key).isNotNull()).groupBy(key).agg(
            sums.alias(f"{key}_sum")), key), key, "left")
    return joined.mapInArrow(
        _fuse(model.labels, model.usual, total), f"id {kind}, language string, confidence double, accepted boolean, "
        "declared string, host string, n_groups long, rid long").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in a language that could be told, with all their columns."""
    rows, rid = with_numbers(docs, None)
    kept = identify_languages(rows, **options, rid=rid).filter("accepted").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)
