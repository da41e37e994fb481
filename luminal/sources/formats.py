"""Text formats: FIX messages, PDB molecules, navigation meshes, near-earth feeds, scanner headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luminal.functions import astro
from luminal.operators.mapping import lookup

# Codes of FIX messages.
MSG_TYPES = {
    "0": "Heartbeat", "1": "TestRequest", "2": "ResendRequest", "3": "Reject", "4": "SequenceReset", "5": "Logout", "6": "IOI", "7": "Advertisement",
    "8": "ExecutionReport", "9": "OrderCancelReject", "A": "Logon", "D": "NewOrderSingle", "E": "NewOrderList", "F": "OrderCancelRequest",
    "G": "OrderCancelReplaceRequest", "H": "OrderStatusRequest", "J": "AllocationInstruction", "K": "ListCancelRequest", "L": "ListExecute",
    "M": "ListStatusRequest", "N": "ListStatus", "P": "AllocationInstructionAck", "Q": "DontKnowTrade", "R": "QuoteRequest", "S": "Quote",
    "T": "SettlementInstructions", "V": "MarketDataRequest", "W": "MarketDataSnapshotFullRefresh", "X": "MarketDataIncrementalRefresh",
    "Y": "MarketDataRequestReject", "Z": "QuoteCancel", "a": "QuoteStatusRequest", "b": "MassQuoteAck", "c": "SecurityDefinitionRequest",
    "d": "SecurityDefinition", "e": "SecurityStatusRequest", "f": "SecurityStatus", "g": "TradingSessionStatusRequest", "h": "TradingSessionStatus",
    "i": "MassQuote", "j": "BusinessMessageReject", "k": "BidRequest", "l": "BidResponse", "m": "ListStrikePrice",
}
SIDES = {"1": "BUY", "2": "SELL", "3": "BUY_MINUS", "4": "SELL_PLUS", "5": "SELL_SHORT", "6": "SELL_SHORT_EXEMPT", "7": "UNDISCLOSED", "8": "CROSS", "9": "CROSS_SHORT"}
ORDER_STATUS = {
    "0": "NEW", "1": "PARTIAL_FILL", "2": "FILLED", "3": "DONE_FOR_DAY", "4": "CANCELLED", "5": "REPLACED", "6": "PENDING_CANCEL", "7": "STOPPED", "8": "REJECTED",
    "9": "SUSPENDED", "A": "PENDING_NEW", "B": "CALCULATED", "C": "EXPIRED", "D": "ACCEPTED_FOR_BIDDING", "E": "PENDING_REPLACE",
}
EXEC_TYPES = {
    "0": "NEW", "1": "PARTIAL_FILL", "2": "FILL", "3": "DONE_FOR_DAY", "4": "CANCELLED", "5": "REPLACE", "6": "PENDING_CANCEL", "7": "STOPPED", "8": "REJECTED", "9": "SUSPENDED",
    "A": "PENDING_NEW", "B": "CALCULATED", "C": "EXPIRED", "D": "RESTATED", "E": "PENDING_REPLACE", "F": "TRADE", "G": "TRADE_CORRECT", "H": "TRADE_CANCEL", "I": "ORDER_STATUS",
}
ORDER_TYPES = {
    "1": "MARKET", "2": "LIMIT", "3": "STOP", "4": "STOP_LIMIT", "5": "MARKET_ON_CLOSE", "6": "WITH_OR_WITHOUT", "7": "LIMIT_OR_BETTER", "8": "LIMIT_WITH_OR_WITHOUT", "9": "ON_BASIS",
    "D": "PREVIOUSLY_QUOTED", "E": "PREVIOUSLY_INDICATED", "G": "FOREX_SWAP", "H": "FUNARI", "I": "MARKET_IF_TOUCHED", "J": "MARKET_WITH_LEFT_OVER_LIMIT",
    "K": "PREVIOUS_FUND_VALUATION_POINT", "L": "NEXT_FUND_VALUATION_POINT", "P": "PEGGED",
}


def fix_pairs(message: Column, separator: str = "|") -> Column:
    """[tag, value] of each part that has both; a value goes as far as a second '='."""
    return F.filter(F.transform(F.split(message, "\\" + separator), lambda p: F.split(p, "=")), lambda p: (F.size(p) >= 2) & (p[0] != "") & (p[1] != ""))


def fix_tag(pairs: Column, tag: str) -> Column:
    """The last value of a tag."""
    return F.try_element_at(F.filter(pairs, lambda p: p[0] == tag), F.lit(-1))[1]


def fix_tags(message: Column, separator: str = "|") -> Column:
    """All tags as a map, the last value of each counting."""
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(1), F.size(pairs))), lambda q: q[0] == p[0]))
    kept = F.transform(F.array(fix_pairs(message, separator)), last)[0]  # bound once, not again for each pair
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p[0], p[1])))


def fix_records(df: DataFrame, message: str = "message", separator: str = "|") -> DataFrame:
    """df with id, symbol, side, quantity, price, status, leaves_qty, cum_qty, avg_px and names of the codes. Numbers that
    cannot be read are 0."""
    tag = lambda t: fix_tag(F.col("_pairs"), t)
    num = lambda t: F.coalesce(tag(t).try_cast("double"), F.lit(0.0))
    name = lambda t, table: F.coalesce(lookup(tag(t), table), tag(t))
    kind = F.coalesce(lookup(tag("35"), MSG_TYPES), F.when(tag("35").isNotNull(), F.concat(F.lit("Unknown("), tag("35"), F.lit(")"))))
    return df.withColumn("_pairs", fix_pairs(F.col(message), separator)).withColumns({
        "id": F.coalesce(tag("11"), tag("37")), "msg_type": kind, "symbol": tag("55"), "side": name("54", SIDES), "quantity": num("38"), "price": num("44"), "status": name("39", ORDER_STATUS),
        "exec_type": name("150", EXEC_TYPES), "order_type": name("40", ORDER_TYPES), "leaves_qty": num("151"), "cum_qty": num("14"), "avg_px": num("6"), "sent": tag("60"),
    }).drop("_pairs")


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of PDB lines (value), by column positions; an occupancy of 0 counts as 1."""
    part = lambda a, n: F.trim(F.substring("value", a, n))
    num = lambda a, n: part(a, n).try_cast("double")
    rows = lines.filter(F.startswith("value", F.lit("ATOM")) | F.startswith("value", F.lit("HETATM")))
    return rows.select(
        part(7, 5).try_cast("int").alias("serial"), part(13, 4).alias("name"), part(17, 1).alias("alt"), part(18, 3).alias("residue"), part(22, 1).alias("chain"),
        part(23, 4).try_cast("int").alias("res_seq"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"),
        F.coalesce(F.nullif(num(55, 6), F.lit(0.0)), F.lit(1.0)).alias("occupancy"), F.coalesce(num(61, 6), F.lit(0.0)).alias("temperature"),
        F.coalesce(F.nullif(part(77, 2), F.lit("")), F.substring(part(13, 4), 1, 1)).alias("element"), part(79, 2).alias("charge"),
    )


def pdb_connections(lines: DataFrame) -> DataFrame:
    """serial and bonded of CONECT lines."""
    parts = F.split(F.trim("value"), r"\s+")
    nums = F.filter(F.transform(F.slice(parts, 2, 100), lambda p: p.try_cast("int")), lambda n: n.isNotNull())
    rows = lines.filter(F.startswith("value", F.lit("CONECT"))).select(nums.alias("_n")).filter(F.size("_n") > 0)
    return rows.select(F.col("_n")[0].alias("serial"), F.slice("_n", 2, 100).alias("bonded"))


def read_pdb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms, and bonds (a, b) as listed or else by distance."""
    from luminal.operators.domains import bonds, listed_bonds

    lines = spark.read.text(path)
    atoms, listed = pdb_atoms(lines), pdb_connections(lines)
    if listed.isEmpty():
        near = bonds(atoms.select(F.col("serial").alias("id"), "x", "y", "z"))
        return atoms, near.select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return atoms, listed_bonds(listed)


def navmesh(df: DataFrame, vertices: str = "verts", polygons: str = "polys", per: int = 6) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z) and polygons (poly_id, vertex_ids) of flat lists: triples of coordinates, and per
    indices a polygon, 65535 standing for none. Polygons of fewer than three vertices are dropped."""
    flat = df.select(F.posexplode(vertices).alias("i", "v"))
    axis = lambda k: F.max(F.when(F.col("i") % 3 == k, F.col("v"))).cast("double")
    v = flat.groupBy(F.floor(F.col("i") / 3).alias("id")).agg(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))
    p = df.select(F.posexplode(polygons).alias("i", "v")).filter("v <> 65535")
    p = p.groupBy(F.floor(F.col("i") / per).alias("poly_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"].cast("long")).alias("vertex_ids"))
    return v, p.filter(F.size("vertex_ids") >= 3)


def near_earth(df: DataFrame) -> DataFrame:
    """Close approaches (des, cd, dist, v_rel, h as text) with date, days, distance, speed, diameter, position and
    hazard class."""
    d = df.withColumns({"ts": astro.parse_date(F.col("cd")), "distance": F.col("dist").try_cast("double"), "velocity": F.col("v_rel").try_cast("double"), "diameter": astro.diameter(F.col("h"))})
    d = d.withColumn("days", astro.days_since_2020(F.col("ts")))
    return d.withColumns(astro.approach_position(F.col("days"), F.col("distance")) | {"distance_km": F.col("distance") * 149_597_870.7, "hazard_class": F.coalesce(astro.hazard_class(F.col("distance")), F.lit("safe"))})


# Elements of a scanner file's header.
DICOM_TAGS = {"00100010": "patient", "00080060": "modality", "00280010": "rows", "00280011": "columns", "00280030": "pixel_spacing", "00180050": "slice_thickness", "00281050": "window_center", "00281051": "window_width", "00281052": "rescale_intercept", "00281053": "rescale_slope"}


def read_dicom(spark: SparkSession, path: str) -> DataFrame:
    """path, tag, vr, name and value (text) of the header elements of scanner files, up to the pixel data; one small
    parser for each file, in the tasks."""
    import struct

    def headers(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                at = 132 if data[128:132] == b"DICM" else 0
                while at + 8 <= len(data):
                    group, element = struct.unpack_from("<HH", data, at)
                    vr = data[at + 4 : at + 6]
                    if vr.isalpha() and vr.isupper():
                        long = vr in (b"OB", b"OW", b"SQ", b"UN", b"UT")
                        n, head = (struct.unpack_from("<I", data, at + 8)[0], 12) if long else (struct.unpack_from("<H", data, at + 6)[0], 8)
                    else:
                        vr, n, head = b"", struct.unpack_from("<I", data, at + 4)[0], 8
                    tag = f"{group:04X}{element:04X}"
                    if tag == "7FE00010" or n == 0xFFFFFFFF:
                        break
                    raw = data[at + head : at + head + n]
                    value = str(struct.unpack("<H", raw)[0]) if vr == b"US" and n == 2 else raw.decode("latin-1").strip("\0 ")
                    rows.append((name, tag, vr.decode(), DICOM_TAGS.get(tag), value))
                    at += head + n
            yield pd.DataFrame(rows, columns=["path", "tag", "vr", "name", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(headers, "path string, tag string, vr string, name string, value string")
