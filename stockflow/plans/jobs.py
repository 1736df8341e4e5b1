"""Write jobs: receipts, transfers, sales, price changes and the reject policy.

Each job takes a DataFrame of requests (one request = one movement with one
line, as the stored procedures write them) and runs the ledger steps as Spark
jobs: build headers and lines with ids continuing after the existing ones,
fill prices, validate against stock in request order, apply the accepted
lines. Results are returned as DataFrames; publishing writes a new version
folder (see ``stockflow.sources.files``), never the folder being read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.operators.ids import id_continue
from stockflow.plans import ledger as L
from stockflow.schema import MONEY
from stockflow.session import kept

Tables = Mapping[str, DataFrame]

# Messages of the status rows.
MSG_OK = {
    "Entrada": "mercadería recibida, movimiento %d",
    "Traslado": "mercadería trasladada, movimiento %d",
    "Salida": "venta asentada, movimiento %d",
}
MSG_ERROR = {
    "Entrada": "recepción no asentada: %s",
    "Traslado": "traslado no asentado: %s",
    "Salida": "venta no asentada: %s",
}


@dataclass
class JobResult:
    results: DataFrame      # one status row per request
    headers: DataFrame      # accepted movement headers (new ids)
    lines: DataFrame        # accepted lines (new ids)
    stock: DataFrame        # new stock version
    decided: DataFrame | None = None        # requests joined with their decision; every output derives from it
    stock_before: DataFrame | None = None
    tipo: str | None = None


def _request_movements(req: DataFrame, t: Tables, tipo: str, origin: str, dest: str | None,
                       supplier: str | None, price, batch_time, tasks: int | None = None) -> DataFrame:
    """Header + line per request; ids continue after the existing movements and lines,
    in request order, numbered in ``tasks`` partitions (Spark's own number, if not given).
    A missing time becomes the batch time (the column default)."""
    when = F.col("fecha_hora") if "fecha_hora" in req.columns else F.lit(None).cast("timestamp_ntz")
    base = req.select(
        "request_id",
        F.coalesce(when, X.ntz(batch_time)).alias("fecha_hora"),
        F.lit(tipo).alias("tipo_movimiento"),
        F.col("observaciones") if "observaciones" in req.columns else F.lit(None).cast("string").alias("observaciones"),
        F.col(origin).cast("bigint").alias("id_sucursal_origen"),
        (F.col(dest).cast("bigint") if dest else F.lit(None).cast("bigint")).alias("id_sucursal_destino"),
        F.col("id_empleado").cast("bigint").alias("id_empleado"),
        (F.col(supplier).cast("bigint") if supplier else F.lit(None).cast("bigint")).alias("id_proveedor"),
        F.col("id_variante").cast("bigint").alias("id_variante"),
        F.col("cantidad").cast("int").alias("cantidad"),
        price.cast(MONEY).alias("precio_unitario"),
        *([F.col("motivo_previo")] if "motivo_previo" in req.columns else []))
    # ranges of request ids, cut into small ones that spread evenly over the tasks
    bucket = ["_rb", "_rs"]
    for name, ids in zip(bucket, (1 << 20, 1 << 14)):
        base = base.withColumn(name, F.floor(F.col("request_id") / F.lit(ids)))
    with_mov = id_continue(base, t["movimientos"], "id_movimiento", ["request_id"], bucket=bucket, tasks=tasks)
    with_ids = id_continue(with_mov, t["detalle_movimientos"], "id_detalle", ["request_id"], bucket=bucket, tasks=tasks)
    return with_ids.drop(*bucket)


def header_checks(m: DataFrame, t: Tables) -> DataFrame:
    """Reasons for which a request's header can't be inserted, after the job's own
    checks and before its line is looked at: the employee is missing, or a branch
    (either role), the employee or the supplier isn't a known key."""
    def known(df, table, key, col):
        keys = t[table].select(F.col(key).cast("bigint").alias(col), F.lit(True).alias(f"_{col}")).distinct()
        return df.join(keys, col, "left")

    x = m
    for table, key, col in (("sucursales", "id_sucursal", "id_sucursal_origen"),
                            ("sucursales", "id_sucursal", "id_sucursal_destino"),
                            ("empleados", "id_empleado", "id_empleado"),
                            ("proveedores", "id_proveedor", "id_proveedor")):
        x = known(x, table, key, col)

    def missing(col):
        return F.col(col).isNotNull() & F.col(f"_{col}").isNull()
    given = F.col("motivo_previo") if "motivo_previo" in m.columns else F.lit(None).cast("string")
    reason = F.coalesce(given, F.when(F.col("id_empleado").isNull(), F.lit(L.REASON_NULL_EMPLOYEE))
                        .when(missing("id_sucursal_origen") | missing("id_sucursal_destino"), F.lit(L.REASON_BRANCH))
                        .when(missing("id_empleado"), F.lit(L.REASON_EMPLOYEE))
                        .when(missing("id_proveedor"), F.lit(L.REASON_SUPPLIER)))
    return x.withColumn("motivo_previo", reason).select(*dict.fromkeys([*m.columns, "motivo_previo"]))


def _run(req: DataFrame, t: Tables, stock: DataFrame, tipo: str) -> JobResult:
    reqs = header_checks(req, t)
    if tipo == "Salida":
        reqs = L.fill_price(reqs, t["producto_variante"], t["productos"])
    reqs = kept(reqs, "requests")       # ids, checks and prices are made once for the replay and the rows after it
    decided = L.validate_stock(reqs, stock=stock, pv=t["producto_variante"])
    out = reqs.select("request_id", "id_movimiento", "id_detalle", "fecha_hora", "observaciones", "id_empleado", "id_proveedor", "precio_unitario").join(
        decided, "id_detalle", "inner")
    return _assemble(out, stock, tipo)


def _assemble(out: DataFrame, stock: DataFrame, tipo: str) -> JobResult:
    """The four job outputs from the decided requests (``out``)."""
    results = out.select(
        "request_id", "id_movimiento", "id_detalle", "id_variante", "id_sucursal_origen", "id_sucursal_destino",
        "cantidad", "precio_unitario", "disponible", "aceptado", "motivo",
        F.when(F.col("aceptado"), F.lit(1)).otherwise(F.lit(0)).alias("filas"),
        F.when(F.col("aceptado"), X.format_message(MSG_OK[tipo], "id_movimiento"))
         .otherwise(X.format_message(MSG_ERROR[tipo], "motivo")).alias("mensaje"))
    acc = out.where("aceptado")
    headers = acc.select("id_movimiento", "fecha_hora", "tipo_movimiento", "observaciones", "id_sucursal_origen",
                         "id_sucursal_destino", "id_empleado", "id_proveedor")
    new_lines = acc.select("id_detalle", "cantidad", "precio_unitario", "id_movimiento", "id_variante")
    return JobResult(results, headers, new_lines, L.apply_accepted(stock, out), out, stock, tipo)


def job_receive(req: DataFrame, t: Tables, stock: DataFrame, batch_time, tasks: int | None = None) -> JobResult:
    """Supplier receipt at a branch: Entrada with supplier, one line at the given price."""
    m = _request_movements(req, t, "Entrada", "id_sucursal", None, "id_proveedor", F.col("precio_unitario"), batch_time, tasks)
    return _run(m, t, stock, "Entrada")


def transfer_checks(req: DataFrame) -> DataFrame:
    """Procedure-level checks of a transfer: origin <> destination, destination not NULL."""
    reason = (F.when(F.col("id_sucursal_origen") == F.col("id_sucursal_destino"), F.lit(L.REASON_SAME_BRANCH))
              .when(F.col("id_sucursal_destino").isNull(), F.lit(L.REASON_NO_DESTINATION)))
    return req.withColumn("motivo_previo", reason)


def job_transfer(req: DataFrame, t: Tables, stock: DataFrame, batch_time, tasks: int | None = None) -> JobResult:
    """Transfer between branches, validated against stock at the origin."""
    m = _request_movements(transfer_checks(req), t, "Traslado", "id_sucursal_origen", "id_sucursal_destino",
                           None, F.col("precio_unitario"), batch_time, tasks)
    return _run(m, t, stock, "Traslado")


def job_sell(req: DataFrame, t: Tables, stock: DataFrame, batch_time, tasks: int | None = None) -> JobResult:
    """Till sale: Salida, line with price 0 filled from the list price, stock checked."""
    m = _request_movements(req, t, "Salida", "id_sucursal", None, None, F.lit(0), batch_time, tasks)
    return _run(m, t, stock, "Salida")


def reprice_brand(prod: DataFrame, brands: DataFrame, id_marca: int, pct) -> tuple[DataFrame, DataFrame]:
    """Change all list prices of one brand by ``pct`` percent.

    Returns (new products, one status row: brand, name, rows touched, ok,
    message). An unknown brand changes nothing and reports an error; a
    result price <= 0 violates ``precio_venta_actual > 0`` and is refused too.
    """
    hit = F.col("id_marca") == F.lit(id_marca)
    new_price = X.percent_adjust("precio_venta_actual", F.lit(str(pct)).cast("decimal(5,2)"))
    brand = brands.where(F.col("id_marca") == F.lit(id_marca)).select(F.col("nombre").alias("marca"))
    touched = prod.where(hit).agg(F.count(F.lit(1)).alias("filas"),
                                  F.sum(F.when(new_price <= 0, 1).otherwise(0)).alias("_bad"))
    exists = brand.exists()
    ok = exists & (F.coalesce(touched.select("_bad").scalar(), F.lit(0)) == 0)
    new_prod = prod.withColumn("precio_anterior", F.col("precio_venta_actual")).withColumn(
        "precio_venta_actual", F.when(ok & hit, new_price).otherwise(F.col("precio_venta_actual")))
    status = touched.select(
        F.lit(id_marca).cast("bigint").alias("id_marca"),
        brand.select("marca").scalar().alias("marca"),
        F.when(ok, F.col("filas")).otherwise(F.lit(0)).cast("bigint").alias("filas"),
        ok.alias("ok"),
        F.when(~exists, X.format_message("no hay marca con el número %d",
                                         F.lit(id_marca)))
         .when(~ok, F.lit("precio_venta_actual > 0 violado"))
         .otherwise(X.format_message("precios cambiados: %d", "filas")).alias("mensaje"))
    return new_prod, status


def reject_policy(res: JobResult, policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(published results, quarantined results).

    ``reject``: bad requests go to quarantine (their header and line are
    dropped), good ones are kept — the savepoint case. ``fail``: any bad
    request aborts the batch: nothing is published, everything is quarantined.
    """
    r = res.results
    if policy == "reject":
        return r.where("aceptado"), r.where(~F.col("aceptado"))
    if policy == "fail":
        any_bad = r.where(~F.col("aceptado")).exists()
        return r.where(~any_bad), r.where(any_bad)
    raise ValueError(f"unknown policy {policy!r}")


def policy_counts(res: JobResult) -> DataFrame:
    """Published and quarantined request counts under both policies, in one pass.

    One aggregation over the results (accepted, rejected, total), then two
    rows derived from it: ``reject`` publishes the accepted ones, ``fail``
    publishes all or nothing. The results are evaluated once, not once per
    policy and side as the four ``reject_policy`` outputs would be.
    """
    acc = F.col("aceptado")
    tot = res.results.agg(F.count(F.lit(1)).alias("_n"),
                          F.count(F.when(acc, 1)).alias("_ok"),
                          F.count(F.when(~acc, 1)).alias("_bad"))
    clean = F.col("_bad") == 0
    return tot.select(F.inline(F.array(
        F.struct(F.lit("reject").alias("politica"), F.col("_ok").alias("publicadas"),
                 F.col("_bad").alias("en_cuarentena")),
        F.struct(F.lit("fail").alias("politica"), F.when(clean, F.col("_n")).otherwise(0).alias("publicadas"),
                 F.when(clean, 0).otherwise(F.col("_n")).alias("en_cuarentena"))))).select(
        "politica", F.col("publicadas").cast("bigint"), F.col("en_cuarentena").cast("bigint"))


def quarantine(res: JobResult, policy: str = "reject") -> DataFrame:
    """The requests that a policy keeps out, header and line columns with their reason; under ``fail`` all of a
    batch with any rejected request (the others with a NULL reason)."""
    if policy not in ("reject", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    d = res.decided
    out = d.where(~F.col("aceptado")) if policy == "reject" else d.where(_any_rejected(d))
    return out.select("request_id", "fecha_hora", "tipo_movimiento", "observaciones", "id_sucursal_origen",
                      "id_sucursal_destino", "id_empleado", "id_proveedor", "id_variante", "cantidad", "precio_unitario", "motivo")


def _any_rejected(decided: DataFrame) -> F.Column:
    return F.coalesce(decided.agg(F.max((~F.col("aceptado")).cast("int")).alias("b")).select("b").scalar(), F.lit(0)) == 1


def policy_rows(res: JobResult) -> DataFrame:
    """Every request under both policies: published, or in quarantine with its reason."""
    r = res.results
    kept_out = F.when(F.col("politica") == "reject", ~F.col("aceptado")).otherwise(_any_rejected(r))
    return r.withColumn("politica", F.explode(F.array(F.lit("reject"), F.lit("fail")))).select(
        "politica", F.when(kept_out, F.lit("cuarentena")).otherwise(F.lit("publicada")).alias("estado"), "request_id",
        "id_movimiento", "id_detalle", "id_sucursal_origen", "id_sucursal_destino", "id_variante", "cantidad",
        "precio_unitario", "motivo")


def quarantined(spark, vdir: str) -> DataFrame:
    """The quarantine of a version folder as requests, to be submitted again once what they lacked
    is there: the columns of all three jobs, ``id_sucursal`` being the origin."""
    q = spark.read.parquet(f"{vdir}/cuarentena")
    return q.withColumn("id_sucursal", F.col("id_sucursal_origen")).drop("motivo", "tipo_movimiento")


def checkpointed(res: JobResult) -> JobResult:
    """The same job result with its decided requests stored (eagerly) in the
    shared checkpoint folder, so outputs used together replay once."""
    if res.decided is None:
        raise ValueError("job result without its decided requests")
    return _assemble(kept(res.decided, "decided"), res.stock_before, res.tipo)


def publish_job(res: JobResult, root: str, policy: str = "reject") -> tuple[str, bool]:
    """Write a job's outputs as one new version folder under ``root`` and publish it.

    The results, headers, lines and new stock all derive from the decided
    requests, so those are checkpointed once to the shared checkpoint folder
    (``spark.checkpoint.dir``) and the four outputs are written from the
    checkpoint: the ordered replay runs once, and a lost executor recomputes
    from the checkpoint, not from the requests. What is accepted and what is
    kept out (``cuarentena``) become visible in one step, by one pointer. Under
    ``fail`` a batch with any rejected request is not published: its folder has the
    whole batch as quarantine, the stock of before, no headers and no lines.
    Returns (version folder, published).
    """
    if policy not in ("reject", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    from stockflow.sources.files import new_version_dir, publish_pointer

    spark = res.results.sparkSession
    r = checkpointed(res)
    ok = policy == "reject" or r.decided.where(~F.col("aceptado")).isEmpty()
    vdir = new_version_dir(root)
    none = F.lit(ok)
    for name, df in (("resultados", r.results), ("movimientos", r.headers.where(none)),
                     ("detalle_movimientos", r.lines.where(none)), ("inventario", r.stock if ok else r.stock_before),
                     ("cuarentena", quarantine(r, policy))):
        df.write.mode("errorifexists").parquet(f"{vdir}/{name}")
    if ok:
        publish_pointer(spark, root, vdir)
    return vdir, ok


def snapshot_states(states: Mapping[str, DataFrame], cells: DataFrame) -> DataFrame:
    """Stock of the given cells in each of the tagged states, stacked."""
    keys = ["id_sucursal", "id_variante"]
    c = kept(cells.select(*keys).distinct(), "cells")     # read once for each state
    parts = [c.join(s, keys, "left").select(*keys, F.lit(tag).alias("etapa"), F.col("cantidad_disponible").alias("cantidad"))
             for tag, s in states.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def job_states(res: JobResult, root: str) -> dict[str, DataFrame]:
    """Stock before, during and after a job, as versions of a stock log under ``root`` read as of their batch.

    The job's requests are applied in two batches, each a delta of the cells that it changes; *during* is the state
    after the first half of the requests' line ids. ``res`` should be checkpointed."""
    from stockflow.sources import stock_log
    from stockflow.streaming.ledger_stream import latest_per_cell

    spark = res.decided.sparkSession
    half = res.decided.agg(F.floor((F.min("id_detalle") + F.max("id_detalle")) / 2)).first()[0] or 0
    stock_log.append(spark, root, res.stock_before, 0)
    stock_log.append(spark, root, latest_per_cell(res.decided.where(F.col("id_detalle") <= half)), 1)
    stock_log.append(spark, root, latest_per_cell(res.decided.where(F.col("id_detalle") > half)), 2)
    return {tag: stock_log.read_stock(spark, root, as_of=n) for n, tag in enumerate(("antes", "durante", "despues"))}


def snapshot_compare(before: DataFrame, after: DataFrame, cells: DataFrame,
                     tags: tuple[str, str] = ("antes", "despues")) -> DataFrame:
    """Stock of the given cells before and after a job, tagged and stacked."""
    return snapshot_states({tags[0]: before, tags[1]: after}, cells)
