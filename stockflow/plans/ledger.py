"""The movement ledger as Spark jobs.

Stock rules (one line of a movement):

* Entrada  adds the quantity at the *origin* branch (the receiving branch);
* Salida   subtracts it at the origin;
* Traslado subtracts it at the origin and adds it at the destination.

``net_stock`` / ``running_balance`` / ``worst_dip`` / ``opening_stock`` /
``final_stock`` replay the history without rejection. ``validate_stock``
replays it *with* rejection: a line that takes stock is accepted only if the
origin cell has at least the quantity left by the accepted lines before it.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions import exprs as X
from stockflow.operators import windows as W
from stockflow.operators.ids import id_before
from stockflow.schema import CONSUMING_TYPES, MONEY
from stockflow.session import kept

HEADER_COLS = ["id_movimiento", "fecha_hora", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino"]


def lines_with_header(mov: DataFrame, det: DataFrame, line_cols: list[str] | None = None) -> DataFrame:
    """Each line with the type, time and branches of its movement (the trigger's SELECT INTO)."""
    line_cols = line_cols or [c for c in det.columns]
    return det.select(*line_cols).join(mov.select(*HEADER_COLS), "id_movimiento", "inner")


def deltas(mov: DataFrame, det: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One signed delta per (line, affected cell): origin deltas UNION ALL destination deltas.

    Done in one pass: each line emits an array of one or two legs that is
    exploded, so the header x detail join runs once.
    ``leg`` is 0 for the origin and 1 for the destination of a transfer.
    """
    keep = list(keep or [])
    lc = ["id_movimiento", "id_variante", "cantidad"] + [c for c in keep if c in det.columns and c not in
                                                         ("id_movimiento", "id_variante", "cantidad")]
    j = lines_with_header(mov, det, lc)
    origin = F.struct(F.col("id_sucursal_origen").alias("id_sucursal"),
                      X.signed_delta().alias("delta"), F.lit(0).alias("leg"))
    dest = F.struct(F.col("id_sucursal_destino").alias("id_sucursal"),
                    F.col("cantidad").alias("delta"), F.lit(1).alias("leg"))
    legs = F.when(F.col("tipo_movimiento") == "Traslado", F.array(origin, dest)).otherwise(F.array(origin))
    out = j.select(*[c for c in j.columns if c not in ("id_sucursal_origen", "id_sucursal_destino")],
                   F.inline(legs))
    return out


def net_stock(mov: DataFrame, det: DataFrame) -> DataFrame:
    """Stock per (branch, variant) = sum of all deltas (the reconciliation side)."""
    return (deltas(mov, det).groupBy("id_sucursal", "id_variante")
            .agg(F.sum("delta").cast("bigint").alias("cantidad")))


def running_balance(mov: DataFrame, det: DataFrame, chunk_lines: int = 1 << 16) -> DataFrame:
    """Balance of the cell after every line leg, in line-id order.

    Cells of a variant of more than ``chunk_lines`` lines are cut by their own row
    counts, so no window partition holds more of them, however their ids are spread;
    other cells have at most two legs of each of their variant's lines.
    """
    d = deltas(mov, det, keep=["id_detalle"]).select("id_detalle", "leg", "id_sucursal", "id_variante", "delta")
    return W.running_sum_split(d, ["id_sucursal", "id_variante"], ["id_detalle", "leg"], "delta", out="saldo",
                               limit=chunk_lines, count_on=det.select("id_variante")).select(
        "id_detalle", "leg", "id_sucursal", "id_variante", "delta", F.col("saldo").cast("bigint").alias("saldo"))


def dips(mov: DataFrame, det: DataFrame, chunk_lines: int = 1 << 16) -> DataFrame:
    """Per cell: lowest balance after any movement (``worst``) and the net (``net``).

    Whether a cell is hot is asked of the lines alone (a cell has at most two legs of
    each line of its variant), so without hot variants the legs are made once and
    shuffled once, by cell.
    """
    d = deltas(mov, det).where(F.col("id_sucursal").isNotNull()).select(
        "id_sucursal", "id_variante", "fecha_hora", "id_movimiento", "delta")
    return W.dip_and_total(d, ["id_sucursal", "id_variante"], ["fecha_hora", "id_movimiento"], "delta",
                           limit=chunk_lines, count_on=det.select("id_variante"))


def worst_dip(mov: DataFrame, det: DataFrame, chunk: Column | None = None, chunk_lines: int | None = 1 << 16,
              tasks: int | None = None) -> DataFrame:
    """Per cell: lowest running balance, capped at 0 (``minimum(min, 0)``), and the net.

    Without ``chunk_lines`` the plan is lazy and cut by ``chunk`` (a column monotone in
    the movement order; the day, if not given), as parallel as that is. ``tasks``: how
    many partitions it then deals rows to; Spark's own number, if not given."""
    if chunk_lines is not None and chunk is None:
        stats = dips(mov, det, chunk_lines).withColumnsRenamed({"worst": "peor", "net": "neto"})
    else:
        d = deltas(mov, det, keep=[]).where(F.col("id_sucursal").isNotNull()).select(
            "id_sucursal", "id_variante", "fecha_hora", "id_movimiento", "delta",
            (chunk if chunk is not None else F.to_date("fecha_hora")).alias("_sf_chunk"))
        stats = W.prefix_min_and_total(d, ["id_sucursal", "id_variante"], ["fecha_hora", "id_movimiento"], "delta",
                                       chunk="_sf_chunk", min_out="peor", total_out="neto", peers=True, tasks=tasks)
    return stats.select("id_sucursal", "id_variante",
                        X.clip_max_zero("peor").cast("bigint").alias("peor_saldo"),
                        F.col("neto").cast("bigint").alias("neto"))


def opening_stock(mov: DataFrame, det: DataFrame, buffer: int | Column = 2, chunk_lines: int | None = 1 << 16,
                  tasks: int | None = None) -> DataFrame:
    """Opening quantity per cell = -worst dip + buffer, so no balance goes negative.

    ``buffer`` may be a column expression over (id_sucursal, id_variante), e.g. a
    hash, in place of a random draw.
    """
    b = F.lit(buffer) if isinstance(buffer, int) else buffer
    return worst_dip(mov, det, chunk_lines=chunk_lines, tasks=tasks).select(
        "id_sucursal", "id_variante",
        (-F.col("peor_saldo") + b).cast("int").alias("cantidad_apertura"), "neto")


def final_stock(mov: DataFrame, det: DataFrame, buffer: int | Column = 2, chunk_lines: int | None = 1 << 16,
                tasks: int | None = None) -> DataFrame:
    """Inventario = opening + net for every cell that has movements."""
    return opening_stock(mov, det, buffer, chunk_lines, tasks).select(
        "id_sucursal", "id_variante",
        (F.col("cantidad_apertura") + F.col("neto")).cast("int").alias("cantidad_disponible"))


def opening_movements(mov: DataFrame, det: DataFrame, prod: DataFrame, pv: DataFrame, opening_time,
                      buffer: int | Column = 2, observation: str = "Apertura de inventario",
                      cost_ratio: str = "0.60", line_ids_before: DataFrame | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """Opening header (one Entrada per branch, dated before all history) and one
    line per cell with the opening quantity, valued at cost.

    Ids follow time: headers are numbered in branch order right before the first
    movement of the history, lines right before the first line of
    ``line_ids_before`` (a table with ``id_detalle``) when it is given, so a replay
    by id takes the opening first. The employee of a branch is the first one by id
    that moves stock there (of all, where nobody does)."""
    op = kept(opening_stock(mov, det, buffer), "opening")    # headers and numbered lines read it several times
    staff = mov.groupBy(F.col("id_sucursal_origen").alias("id_sucursal")).agg(F.min("id_empleado").alias("_emp"))
    anyone = mov.agg(F.min("id_empleado").alias("e")).select("e").scalar()
    branches = (op.select("id_sucursal").distinct().join(staff, "id_sucursal", "left"))
    headers = id_before(branches, mov, "id_movimiento", [F.col("id_sucursal").desc()]).select(
        "id_movimiento", X.ntz(opening_time).alias("fecha_hora"),
        F.lit("Entrada").alias("tipo_movimiento"), F.lit(observation).alias("observaciones"),
        F.col("id_sucursal").alias("id_sucursal_origen"),
        F.lit(None).cast("bigint").alias("id_sucursal_destino"),
        F.coalesce("_emp", anyone).cast("bigint").alias("id_empleado"),
        F.lit(None).cast("bigint").alias("id_proveedor"))
    price = pv.select("id_variante", "id_producto").join(prod.select("id_producto", "precio_venta_actual"),
                                                         "id_producto", "inner")
    lines = (op.join(headers.select("id_movimiento", F.col("id_sucursal_origen").alias("id_sucursal")),
                     "id_sucursal", "inner")
             .join(price, "id_variante", "left"))
    cols = [F.col("cantidad_apertura").alias("cantidad"),
            F.coalesce(X.cost_price("precio_venta_actual", cost_ratio), F.lit(0).cast(MONEY)).alias("precio_unitario"),
            "id_movimiento", "id_variante"]
    if line_ids_before is not None:
        # numbered backwards: branches descending, cut by ranges of the variant id
        lines = (lines.withColumn("_sf_nb", -F.col("id_sucursal"))
                 .withColumn("_sf_nv", -F.floor(F.col("id_variante") / F.lit(1 << 16))))
        lines = id_before(lines, line_ids_before, "id_detalle",
                          [F.col("id_sucursal").desc(), F.col("id_variante").desc()], bucket=["_sf_nb", "_sf_nv"])
        cols = ["id_detalle"] + cols
    return headers, lines.select(*cols)


# ---------------------------------------------------------------------------
# Price fill (BEFORE trigger 1)
# ---------------------------------------------------------------------------
def fill_price(lines: DataFrame, pv: DataFrame, prod: DataFrame, tipo_col: str = "tipo_movimiento") -> DataFrame:
    """A sale line with price exactly 0 gets the product's list price; kept 0 if none.

    Adds ``precio_original`` and ``precio_completado`` (bool)."""
    price = pv.select("id_variante", "id_producto").join(
        prod.select("id_producto", F.col("precio_venta_actual").alias("_lista")), "id_producto", "inner"
    ).select("id_variante", "_lista")
    j = lines.join(price, "id_variante", "left")
    needs = (F.col(tipo_col) == "Salida") & (F.col("precio_unitario") == 0)
    filled = needs & F.col("_lista").isNotNull()
    return (j.withColumn("precio_original", F.col("precio_unitario"))
             .withColumn("precio_completado", filled)
             .withColumn("precio_unitario", F.when(filled, F.col("_lista")).otherwise(F.col("precio_unitario")))
             .drop("_lista"))


# ---------------------------------------------------------------------------
# Stock validation with rejection (BEFORE trigger 2 + CHECKs + AFTER trigger)
# ---------------------------------------------------------------------------
REASON_SAME_BRANCH = "origen y destino iguales"
REASON_NO_DESTINATION = "traslado sin destino"
REASON_STOCK = "stock insuficiente"
REASON_QUANTITY = "cantidad <= 0"
REASON_PRICE = "precio < 0"
REASON_NO_BRANCH = "sucursal nula"
REASON_UNKNOWN = "clave desconocida"
REASON_NULL_EMPLOYEE = "empleado nulo"
REASON_BRANCH = "sucursal desconocida"
REASON_EMPLOYEE = "empleado desconocido"
REASON_SUPPLIER = "proveedor desconocido"
REASON_NULL_QUANTITY = "cantidad nula"
REASON_NULL_VARIANT = "variante nula"
_NONE = -(1 << 63)   # stands for NULL in the replay, so that ids stay whole numbers

FOLD_SCHEMA = T.StructType([
    T.StructField("id_detalle", T.LongType()),
    T.StructField("id_variante", T.LongType()),
    T.StructField("tipo_movimiento", T.StringType()),
    T.StructField("id_sucursal_origen", T.LongType()),
    T.StructField("id_sucursal_destino", T.LongType()),
    T.StructField("cantidad", T.IntegerType()),
    T.StructField("disponible", T.LongType()),
    T.StructField("aceptado", T.BooleanType()),
    T.StructField("motivo", T.StringType()),
    T.StructField("saldo_origen", T.LongType()),
    T.StructField("saldo_destino", T.LongType()),
])


_WHOLE = ("id_detalle", "id_variante", "id_sucursal_origen", "id_sucursal_destino", "cantidad", "disponible",
          "saldo_origen", "saldo_destino")


def decided_frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of FOLD_SCHEMA; whole numbers with NULLs stay whole numbers."""
    cols = zip([f.name for f in FOLD_SCHEMA.fields], zip(*rows))
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in _WHOLE else list(c) for n, c in cols})


def replay_line(stock: dict, t, o, d, q, pre, null, late):
    """The rule for one line against ``stock`` (branch -> units of its variant), which it
    changes when the line is accepted. Returns available units, reason (None: accepted)
    and the balances of origin and destination after it."""
    avail = stock.get(o, 0) if o is not None else 0
    if pre is None and null is None and late is None and q > 0 and o is not None and d is None:
        # most lines, by the rules below: a receipt or a sale that nothing but stock can stop
        if t == "Entrada":
            stock[o] = avail + q
            return avail, None, avail + q, None
        if t == "Salida" and avail >= q:
            stock[o] = avail - q
            return avail, None, avail - q, None
    reason = pre if isinstance(pre, str) else None
    if reason is None and t in CONSUMING_TYPES and avail < q and null != REASON_NULL_QUANTITY:
        reason = REASON_STOCK
    if reason is None and isinstance(null, str):
        reason = null
    if reason is None and q <= 0:
        reason = REASON_QUANTITY
    if reason is None and isinstance(late, str):
        reason = late
    if reason is None and ((t == "Entrada" and o is None) or (t == "Traslado" and d is None)):
        reason = REASON_NO_BRANCH
    if reason is None:
        if t == "Entrada":
            stock[o] = stock.get(o, 0) + q
        elif t in CONSUMING_TYPES:
            if o in stock:
                stock[o] -= q
            if t == "Traslado":
                stock[d] = stock.get(d, 0) + q
    return (avail, reason, stock.get(o) if o is not None else None, stock.get(d) if d is not None else None)


def _fold_partition(batches):
    """Replay one partition sorted by (id_variante, cell key, kind, id_detalle).

    State is the branch -> stock map of the *current* key only (a variant, or
    one cell of a transfer-free variant), so memory is O(branches) whatever
    the size of a key; rows stream through in Arrow batches and are never
    gathered per group.

    Reasons in the order the write path meets them: a reason found before the
    line reached the ledger (``_pre``), stock at origin, a NULL quantity or
    variant (``_null``), quantity, then the constraint errors found after that
    (``_late``: price, unknown key), then a NULL receiving branch. Numbers come
    without NULLs (``_NONE`` instead).
    """
    cur = None
    stock: dict = {}
    for pdf in batches:
        rows = []
        ck = pdf["_ck"].to_numpy()
        kind = pdf["_kind"].to_numpy()
        var = pdf["id_variante"].to_numpy()
        br = pdf["id_sucursal_origen"].to_numpy()
        de = pdf["id_sucursal_destino"].to_numpy()
        qty = pdf["cantidad"].to_numpy()
        tipo = pdf["tipo_movimiento"].to_numpy()
        pre = pdf["_pre"].to_numpy()
        late = pdf["_late"].to_numpy()
        null = pdf["_null"].to_numpy()
        ids = pdf["id_detalle"].to_numpy()
        init = pdf["_init"].to_numpy()
        for i in range(len(pdf)):
            v = var[i]
            if (v, ck[i]) != cur:
                cur, stock = (v, ck[i]), {}
            if kind[i] == 0:             # starting stock of a cell
                stock[int(br[i])] = int(init[i])
                continue
            o = None if br[i] == _NONE else int(br[i])
            d = None if de[i] == _NONE else int(de[i])
            q = int(qty[i])
            avail, reason, so, sd = replay_line(stock, tipo[i], o, d, q, pre[i], null[i], late[i])
            rows.append((int(ids[i]), None if v == _NONE else int(v), tipo[i], o, d,
                         None if null[i] == REASON_NULL_QUANTITY else q, int(avail), reason is None, reason, so, sd))
        if rows:
            yield decided_frame(rows)


def _prepare(lines: DataFrame, pv: DataFrame | None) -> DataFrame:
    """Reasons known before the replay: ``_pre`` (given), ``_late`` (price, unknown variant)."""
    pre = F.col("motivo_previo") if "motivo_previo" in lines.columns else F.lit(None).cast("string")
    late = F.when(F.col("precio_unitario") < 0, F.lit(REASON_PRICE))
    null = (F.when(F.col("cantidad").isNull(), F.lit(REASON_NULL_QUANTITY))
            .when(F.col("id_variante").isNull(), F.lit(REASON_NULL_VARIANT)))
    l = lines.withColumn("_pre", pre).withColumn("_null", null)
    if pv is not None:
        known = pv.select("id_variante", F.lit(True).alias("_known"))
        l = l.join(known, "id_variante", "left")
        late = late.when(F.col("_known").isNull(), F.lit(REASON_UNKNOWN))
    return l.withColumn("_late", late).select(
        _whole("id_detalle"), _whole("id_variante"), "tipo_movimiento", _whole("id_sucursal_origen"),
        _whole("id_sucursal_destino"), F.coalesce(F.col("cantidad").cast("int"), F.lit(0)).alias("cantidad"),
        "_pre", "_late", "_null")


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(_NONE)).alias(name)


def line_events(l: DataFrame, key: Column, row: Column) -> DataFrame:
    """Prepared lines as events of the replay: ``_ck`` tells the replays of one variant apart."""
    return l.select(F.lit(1).alias("_kind"), key.cast("bigint").alias("_ck"), row.alias("_row"), "id_detalle", "id_variante",
                    "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino", "cantidad", "_pre", "_late", "_null",
                    F.lit(0).cast("bigint").alias("_init"))


def start_events(stock: DataFrame, key: Column) -> DataFrame:
    """Stock rows (id_sucursal, id_variante, cantidad_disponible) as the events that a replay begins with."""
    text = F.lit(None).cast("string")
    return stock.select(
        F.lit(0).alias("_kind"), key.cast("bigint").alias("_ck"), F.lit(_NONE).alias("_row"), F.lit(_NONE).alias("id_detalle"),
        F.col("id_variante").cast("bigint").alias("id_variante"), text.alias("tipo_movimiento"),
        F.col("id_sucursal").cast("bigint").alias("id_sucursal_origen"), F.lit(_NONE).alias("id_sucursal_destino"),
        F.lit(0).alias("cantidad"), text.alias("_pre"), text.alias("_late"), text.alias("_null"),
        F.coalesce(F.col("cantidad_disponible").cast("bigint"), F.lit(0)).alias("_init"))


def in_replay_order(events: DataFrame, n: int | None = None) -> DataFrame:
    """One shuffle by (variant, replay), sorted: the start first, then the lines in order."""
    keys = ["id_variante", "_ck"]
    dealt = events.repartition(n, *keys) if n else events.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "_kind", "_row")


def fold(events: DataFrame, n: int | None = None) -> DataFrame:
    """Line-by-line replay, streamed: a task holds the branches of one (variant, replay) at a time."""
    return in_replay_order(events, n).mapInPandas(_fold_partition, FOLD_SCHEMA)


def _whole_variants(l: DataFrame, stock: DataFrame | None, n: int | None) -> DataFrame:
    events = line_events(l, F.lit(-1), F.col("id_detalle"))
    if stock is not None:
        s = stock.join(l.select("id_variante").distinct(), "id_variante", "left_semi")
        events = events.unionByName(start_events(s, F.lit(-1)))
    return fold(events, n)


def validate_stock(lines: DataFrame, stock: DataFrame | None = None, pv: DataFrame | None = None,
                   num_partitions: int | None = None, split: bool = False, chunk_lines: int = 1 << 12,
                   hot_lines: int = 1 << 18, count_on: DataFrame | None = None) -> DataFrame:
    """Accept or reject every line in ``id_detalle`` order against the stock left by earlier accepted lines.

    ``lines``: id_detalle, id_variante, cantidad, precio_unitario, tipo_movimiento,
    id_sucursal_origen, id_sucursal_destino (optionally ``motivo_previo``, a
    reason found before the line reached the ledger, e.g. by a procedure check).
    ``stock``: starting inventario (missing cell = 0). ``pv``: variants, for the
    foreign-key check.

    A line touches one variant only, and a transfer couples two cells of that
    same variant, so a variant is an exact unit of replay: one shuffle by variant,
    and a fold that streams it in memory of its branches. A variant of more than
    ``hot_lines`` lines is replayed in chunks, in parallel (``plans.replay``); with
    ``split`` all are. Both ways give the same rows, also for NULLs, unknown types and
    repeated ids. ``count_on``: a cheaper frame that has ``id_variante`` as often as
    ``lines`` at least, to find the hot variants by.
    """
    from stockflow.plans.replay import replay_in_chunks

    n = num_partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l = _prepare(lines, pv)
    counted = None if count_on is None else count_on.select(_whole("id_variante"))
    cold, hot = W.split_hot(l, ["id_variante"], 0 if split else hot_lines, counted)
    if hot is None:
        return _whole_variants(cold, stock, n)
    return _whole_variants(cold, stock, n).unionByName(replay_in_chunks(hot, stock, chunk_lines))


def apply_accepted(stock: DataFrame, decided: DataFrame) -> DataFrame:
    """New stock = old stock + deltas of accepted lines; missing cells are created.

    Full outer join of the old cells with the summed deltas (written as a new
    version by the caller; the source is never overwritten in place).
    """
    acc = decided.where("aceptado")
    origin = acc.select(F.col("id_sucursal_origen").alias("id_sucursal"), "id_variante",
                        F.when(F.col("tipo_movimiento") == "Entrada", F.col("cantidad"))
                        .otherwise(-F.col("cantidad")).alias("delta"))
    dest = acc.where(F.col("tipo_movimiento") == "Traslado").select(
        F.col("id_sucursal_destino").alias("id_sucursal"), "id_variante", F.col("cantidad").alias("delta"))
    net = origin.unionByName(dest).groupBy("id_sucursal", "id_variante").agg(F.sum("delta").alias("_d"))
    return (stock.join(net, ["id_sucursal", "id_variante"], "full")
            .select("id_sucursal", "id_variante",
                    (F.coalesce(F.col("cantidad_disponible"), F.lit(0)) + F.coalesce(F.col("_d"), F.lit(0)))
                    .cast("int").alias("cantidad_disponible")))


# The fold runs in Python workers, which may not have this package on their
# path (a driver-side checkout, no --py-files): ship the worker function by
# value. It only uses pandas and the constants above.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
