"""Integrity and data-quality jobs: the declared constraints checked as Spark jobs.

Parquet tables have no UPDATE, MERGE or ADD CONSTRAINT, so every constraint
of the model is a check job here. Each check reads whole tables, aggregates
on the executors and returns a small result DataFrame (counts, plus an
ordered sample of at most 5 offending rows where the reference prints one).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow import schema as S
from stockflow.plans import ledger as L
from stockflow.sources.testdata import lines

Tables = Mapping[str, DataFrame]


def _stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _count_where(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _table(t: Tables, name: str) -> DataFrame:
    # Line ids are needed only by checks on id_detalle itself.
    return t[name]


def not_null(t: Tables) -> DataFrame:
    """Rows with NULL in each NOT NULL column; one aggregate per table."""
    out = []
    by_table: dict[str, list[str]] = {}
    for tab, col in S.NOT_NULL:
        by_table.setdefault(tab, []).append(col)
    for tab, cols in by_table.items():
        df = _table(t, tab)
        agg = df.agg(*[_count_where(F.col(c).isNull()).alias(c) for c in cols])
        out.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(tab).alias("tabla"), F.lit(c).alias("columna"), F.col(c).alias("filas_nulas"))
            for c in cols]))).select("col.*"))
    return _stack(out)


def _per_table(t: Tables, checks, lines_without_ids: bool = True) -> DataFrame:
    """``checks``: (table, violated condition, literal columns). One aggregate per
    table counts all its conditions; the rows have the literals and the count ``_n``."""
    by_table: dict[str, list] = {}
    for tab, cond, cols in checks:
        by_table.setdefault(tab, []).append((cond, cols))
    out = []
    for tab, own in by_table.items():
        df = _lines_or(t, tab) if lines_without_ids else t[tab]
        agg = df.agg(*[F.coalesce(_count_where(cond), F.lit(0).cast("bigint")).alias(f"c{i}")
                       for i, (cond, _) in enumerate(own)])
        out.append(agg.select(F.explode(F.array(*[
            F.struct(*[F.lit(v).alias(k) for k, v in cols.items()], F.col(f"c{i}").alias("_n"))
            for i, (_, cols) in enumerate(own)]))).select("col.*"))
    return _stack(out)


def max_length(t: Tables) -> DataFrame:
    """Rows longer than the declared VARCHAR(n) per column; one aggregate per table."""
    return _per_table(t, [(tab, F.length(col) > n, {"tabla": tab, "columna": col, "limite": n})
                          for tab, col, n in S.MAX_LENGTHS]).withColumnRenamed("_n", "filas_largas")


def _tagged(t: Tables, wanted: Mapping[str, list], line_ids: bool = False) -> DataFrame:
    """(tag, keys...) rows of all tables, each table scanned once: ``wanted`` has, per table, a struct for each
    tagged key that its rows give."""
    return _stack((t[tab] if line_ids else _lines_or(t, tab)).select(F.inline(F.array(*structs)))
                  for tab, structs in wanted.items())


def _by_tag(groups: DataFrame, labels: list[dict], **sums) -> DataFrame:
    """One row a tag, also for tags without groups: its labels and sums. One aggregate with a sum for each tag."""
    total = [F.coalesce(F.sum(F.when(F.col("tag") == i, value)), F.lit(0)).cast("bigint").alias(f"{name}{i}")
             for i in range(len(labels)) for name, value in sums.items()]
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in own.items()], *[F.col(f"{name}{i}").alias(name) for name in sums])
            for i, own in enumerate(labels)]
    return groups.agg(*total).select(F.inline(F.array(*rows)))


def primary_key(t: Tables) -> DataFrame:
    """Per table: keys that occur more than once, and rows with a NULL key part. One tagged shuffle for all tables."""
    wanted, labels = {}, []
    for i, (tab, keys) in enumerate(S.PRIMARY_KEYS.items()):
        parts = [F.col(k).cast("string") for k in keys]
        missing = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
        # rows without a whole key meet in one group, summed before the shuffle
        wanted[tab] = [F.struct(F.lit(i).alias("tag"), missing.alias("missing"),
                                F.when(~missing, F.array(*parts)).alias("k"))]
        labels.append({"tabla": tab})
    groups = _tagged(t, wanted, line_ids=True).groupBy("tag", "missing", "k").agg(F.count(F.lit(1)).alias("n"))
    return _by_tag(groups, labels, claves_duplicadas=F.when(~F.col("missing") & (F.col("n") > 1), 1),
                   claves_nulas=F.when(F.col("missing"), F.col("n")))


def unique(t: Tables) -> DataFrame:
    """Per UNIQUE column: values held by more than one row (NULLs never clash). One tagged shuffle for all columns."""
    wanted: dict[str, list] = {}
    for i, (tab, col) in enumerate(S.UNIQUE_KEYS):
        wanted.setdefault(tab, []).append(F.struct(F.lit(i).alias("tag"), F.col(col).cast("string").alias("k")))
    groups = _tagged(t, wanted).where(F.col("k").isNotNull()).groupBy("tag", "k").agg(F.count(F.lit(1)).alias("n"))
    return _by_tag(groups, [{"tabla": tab, "columna": col} for tab, col in S.UNIQUE_KEYS],
                   valores_duplicados=F.when(F.col("n") > 1, 1))


def domain_in(t: Tables) -> DataFrame:
    """Rows whose value is outside the CHECK list (NULL passes a CHECK)."""
    return _per_table(t, [(tab, F.col(col).isNotNull() & ~F.col(col).isin(allowed), {"tabla": tab, "columna": col})
                          for tab, col, allowed in S.DOMAINS]).withColumnRenamed("_n", "filas_fuera_de_dominio")


def numeric(t: Tables) -> DataFrame:
    """Rows violating each numeric CHECK (a NULL result passes)."""
    return _per_table(t, [(tab, ~F.expr(pred), {"restriccion": name, "tabla": tab})
                          for name, tab, pred in S.NUMERIC_CHECKS]).withColumnRenamed("_n", "filas_invalidas")


def _lines_or(t: Tables, tab: str) -> DataFrame:
    return lines(t) if tab == "detalle_movimientos" else t[tab]


def foreign_key(t: Tables) -> DataFrame:
    """Child rows whose non-NULL key has no parent, for all references in one tagged shuffle.

    Each table is scanned once and gives, for every reference that it takes part in,
    its keys as a child (counted) or as a parent. After one sum per (reference, key),
    made on the map side first, a key without a parent has its child rows as orphans."""
    wanted: dict[str, list] = {}

    def give(tab, tag, col, as_child):
        wanted.setdefault(tab, []).append(F.struct(F.lit(tag).alias("tag"), F.col(col).cast("bigint").alias("k"),
                                                   F.lit(int(as_child)).alias("child")))
    for i, (child, ccol, parent, pcol, _) in enumerate(S.FOREIGN_KEYS):
        give(child, i, ccol, True)
        give(parent, i, pcol, False)
    groups = _tagged(t, wanted).where(F.col("k").isNotNull()).groupBy("tag", "k").agg(
        F.sum("child").alias("n"), F.min("child").alias("orphan"))
    return _by_tag(groups, [{"tabla": c, "columna": cc, "tabla_padre": p} for c, cc, p, _, _ in S.FOREIGN_KEYS],
                   huerfanas=F.when(F.col("orphan") == 1, F.col("n")))


def non_empty(t: Tables, names: Iterable[str] = S.TABLE_NAMES) -> DataFrame:
    """Row count per table (``rpad`` name for the report) and whether it is empty."""
    out = []
    for n in names:
        out.append(_lines_or(t, n).agg(F.count(F.lit(1)).cast("bigint").alias("filas")).select(
            F.lit(n).alias("tabla"), "filas", F.rpad(F.lit(n), 22, " ").alias("etiqueta"),
            (F.col("filas") == 0).alias("vacia")))
    return _stack(out)


def tables_present(spark, expected: Iterable[str], present: Iterable[str]) -> DataFrame:
    """Expected table names that are missing, as one sorted, joined list.

    ``present`` is the catalog's list of names (a handful of strings)."""
    exp = spark.createDataFrame([(n,) for n in expected], "t string")
    pres = spark.createDataFrame([(n,) for n in present], "t string")
    missing = exp.join(pres, "t", "left_anti")
    return missing.agg(F.count(F.lit(1)).cast("bigint").alias("faltantes"),
                       F.array_join(F.sort_array(F.collect_list("t")), ", ").alias("lista"))


def sample_text(df: DataFrame, order: list[str], fmt: str, cols: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in ``order`` formatted and joined with '; ' (a message sample).

    ``orderBy().limit(n)`` plans as a top-k: each task keeps n rows, so only
    n x tasks rows ever reach the final step."""
    first = df.orderBy(*order).limit(n)
    items = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order],
                                                 F.format_string(fmt, *cols).alias("_m"))))
    # No offending row -> NULL (as string_agg over nothing), not ''.
    return first.agg(F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda s: s["_m"]), "; "))
                     .alias("detalle"))


def no_negative_stock(t: Tables) -> DataFrame:
    """Count of cells with stock < 0 and the first 5 of them."""
    inv = t["inventario"]
    neg = inv.where(F.col("cantidad_disponible") < 0)
    cnt = neg.agg(F.count(F.lit(1)).cast("bigint").alias("negativas"))
    txt = sample_text(neg, ["id_sucursal", "id_variante"], "(sucursal %d, variante %d) = %d",
                      ["id_sucursal", "id_variante", "cantidad_disponible"])
    return cnt.select("negativas", txt.select("detalle").scalar().alias("detalle"))


def reconcile(inv: DataFrame, net: DataFrame) -> DataFrame:
    """Full outer join of stock and recomputed net per cell; keys coalesced; only differing cells."""
    n = net.select(F.col("id_sucursal").alias("_s"), F.col("id_variante").alias("_v"),
                   F.col("cantidad").alias("recalculado"))
    i = inv.select("id_sucursal", "id_variante", F.col("cantidad_disponible").alias("en_inventario"))
    # NULL keys never match in SQL: a NULL branch on either side stays unmatched.
    j = i.join(n, (F.col("id_sucursal") == F.col("_s")) & (F.col("id_variante") == F.col("_v")), "full")
    return (j.select(F.coalesce("id_sucursal", "_s").alias("id_sucursal"),
                     F.coalesce("id_variante", "_v").alias("id_variante"),
                     F.col("en_inventario").cast("bigint").alias("en_inventario"),
                     F.col("recalculado").cast("bigint").alias("recalculado"))
            .where(F.coalesce("en_inventario", F.lit(0)) != F.coalesce("recalculado", F.lit(0))))


def stock_reconciles(inv: DataFrame, mov: DataFrame, det: DataFrame) -> DataFrame:
    """Cells where stock differs from the net of the movement history: count and first 5."""
    diff = reconcile(inv, L.net_stock(mov, det))
    cnt = diff.agg(F.count(F.lit(1)).cast("bigint").alias("discrepancias"))
    txt = sample_text(diff, ["id_sucursal", "id_variante"],
                      "(sucursal %d, variante %d) inventario %d, recalculado %d",
                      ["id_sucursal", "id_variante", "en_inventario", "recalculado"])
    return cnt.select("discrepancias", txt.select("detalle").scalar().alias("detalle"))


def generated_invariants(inv: DataFrame, mov: DataFrame, det: DataFrame) -> DataFrame:
    """Final stock >= 0, line quantity > 0, unique line and movement ids."""
    neg = inv.agg(_count_where(F.col("cantidad_disponible") < 0).alias("stock_negativo"))
    bad_q = det.agg(_count_where(F.col("cantidad") <= 0).alias("cantidad_no_positiva"))
    dup_l = det.groupBy("id_detalle").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    dup_m = mov.groupBy("id_movimiento").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return neg.select(
        F.coalesce("stock_negativo", F.lit(0)).cast("bigint").alias("stock_negativo"),
        F.coalesce(bad_q.select("cantidad_no_positiva").scalar(), F.lit(0)).cast("bigint").alias("cantidad_no_positiva"),
        dup_l.select("n").scalar().cast("bigint").alias("ids_detalle_repetidos"),
        dup_m.select("n").scalar().cast("bigint").alias("ids_movimiento_repetidos"))


# ---------------------------------------------------------------------------
# Referential actions
# ---------------------------------------------------------------------------
def _row_key(tab: str) -> F.Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in S.PRIMARY_KEYS[tab]])


def delete_effects(t: Tables, doomed: Mapping[str, DataFrame]) -> DataFrame:
    """Every child row that a delete of the ``doomed`` keys (parent table -> its key
    column) meets, over all foreign keys: the row goes with its parent (CASCADE) or
    holds it back (RESTRICT)."""
    out = []
    for child, ccol, parent, pcol, action in S.FOREIGN_KEYS:
        if parent not in doomed:
            continue
        keys = doomed[parent].select(F.col(pcol).alias(ccol)).distinct()
        hit = t[child].join(keys, ccol, "left_semi")
        out.append(hit.select(F.lit(parent).alias("tabla_padre"), F.col(ccol).cast("bigint").alias("clave"),
                              F.lit(child).alias("tabla"), F.lit(ccol).alias("columna"), _row_key(child).alias("fila"),
                              F.lit("cascada" if action == "CASCADE" else "bloquea").alias("accion")))
    return _stack(out)


def rekey_effects(t: Tables, offset: int) -> DataFrame:
    """ON UPDATE CASCADE when all parents' keys move by ``offset``: for every foreign
    key and child row, the row (by its old key), and its new foreign key."""
    out = []
    for child, ccol, parent, pcol, _ in S.FOREIGN_KEYS:
        mapping = t[parent].select(F.col(pcol).alias("old"), (F.col(pcol) + offset).alias("new"))
        marked = t[child].withColumn("_fila", _row_key(child))
        new = rekey_cascade({parent: t[parent], child: marked}, parent, mapping, only=(child, ccol))[child]
        out.append(new.select(F.lit(child).alias("tabla"), F.lit(ccol).alias("columna"), F.col("_fila").alias("fila"),
                              F.col(ccol).cast("bigint").alias("clave_nueva")))
    return _stack(out)


def delete_cascade(t: Tables, parent: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete the parent rows whose key is in ``doomed`` (one key column).

    CASCADE children lose their rows; a RESTRICT child that references a
    doomed key blocks that key (it stays). Returns the new tables plus
    ``_blocked`` (keys kept because of RESTRICT).
    """
    pcol = S.PRIMARY_KEYS[parent][0]
    keys = doomed.select(F.col(pcol)).distinct()
    blocked = None
    for child, ccol, par, _pc, action in S.FOREIGN_KEYS:
        if par != parent or action != "RESTRICT":
            continue
        refs = _lines_or(t, child).select(F.col(ccol).alias(pcol))
        b = keys.join(refs, pcol, "left_semi")
        blocked = b if blocked is None else blocked.unionByName(b)
    go = keys if blocked is None else keys.join(blocked, pcol, "left_anti")
    out = {parent: t[parent].join(go, pcol, "left_anti")}
    for child, ccol, par, _pc, action in S.FOREIGN_KEYS:
        if par == parent and action == "CASCADE":
            out[child] = _lines_or(t, child).join(go.select(F.col(pcol).alias(ccol)), ccol, "left_anti")
    out["_blocked"] = blocked.distinct() if blocked is not None else keys.limit(0)
    out["_deleted"] = go
    return out


def rekey_cascade(t: Tables, parent: str, mapping: DataFrame, only: tuple[str, str] | None = None
                  ) -> dict[str, DataFrame]:
    """ON UPDATE CASCADE: change parent keys (``mapping``: old, new) and rewrite every
    child, or ``only`` one (table, column) of them."""
    pcol = S.PRIMARY_KEYS[parent][0]
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))

    def remap(df: DataFrame, col: str) -> DataFrame:
        return (df.join(m, F.col(col) == F.col("_old"), "left")
                .withColumn(col, F.coalesce("_new", col)).drop("_old", "_new"))

    out = {parent: remap(t[parent], pcol)}
    for child, ccol, par, _pc, _a in S.FOREIGN_KEYS:
        if par == parent and only in (None, (child, ccol)):
            out[child] = remap(out.get(child, _lines_or(t, child)), ccol)
    return out
