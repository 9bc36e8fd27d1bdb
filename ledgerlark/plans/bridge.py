"""Inputs of the domain made from the common tables, by SQL that Spark and DuckDB run alike.

Values come from keys and whole numbers only, so both engines make the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.dealing import dealt
from ..sources.tables import read_table

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels benchmark".split()


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """``sql`` with ``{table}`` names, over the tables of a folder."""
    return spark.sql(sql, **{t: read_table(spark, folder, t) for t in TABLES if "{" + t + "}" in sql})


def twin(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


SHIPMENTS = """
SELECT o.o_orderkey AS k, l.cnt AS cnt, l.qty AS qty, s.s_name AS s_name, c.c_name AS c_name, sn.n_name AS from_nation, sr.r_name AS from_region, cn.n_name AS to_nation, cr.r_name AS to_region
FROM {orders} o
JOIN (SELECT l_orderkey, count(*) AS cnt, min(l_suppkey) AS sk, CAST(sum(l_quantity) AS BIGINT) AS qty FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN {supplier} s ON s.s_suppkey = l.sk JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} sn ON sn.n_nationkey = s.s_nationkey JOIN {region} sr ON sr.r_regionkey = sn.n_regionkey
JOIN {nation} cn ON cn.n_nationkey = c.c_nationkey JOIN {region} cr ON cr.r_regionkey = cn.n_regionkey
"""
_SIDES_OF = """
SELECT k,
  CASE WHEN k % 31 = 0 THEN 'N/A' ELSE concat(s_name, ' LIMITED') END AS si_shipper,
  CASE WHEN k % 7 = 0 THEN concat(s_name, ' EAST Ltd.') ELSE concat(lower(s_name), ' Ltd.') END AS bl_shipper,
  concat(c_name, ' CO., LTD') AS si_consignee,
  CASE WHEN k % 11 = 0 THEN concat('Other ', c_name) ELSE concat(c_name, ' Company Limited') END AS bl_consignee,
  concat(c_name, ' on behalf of ', s_name) AS si_notify_party,
  CASE WHEN k % 13 = 0 THEN concat(c_name, ' ON BEHALF OF ', c_name) WHEN k % 3 = 0 THEN upper(c_name) ELSE concat(c_name, ' on behalf of ', lower(s_name)) END AS bl_notify_party,
  concat(from_nation, ', ', from_region, ' (ABCDE)') AS si_port_of_loading,
  CASE WHEN k % 17 = 0 THEN concat('Port ', from_nation, ', ', from_region) ELSE concat(lower(from_nation), ' (WEST) , ', from_region) END AS bl_port_of_loading,
  concat(to_nation, ', ', to_region) AS si_port_of_discharge,
  CASE WHEN k % 19 = 0 THEN concat(to_nation, ', OTHER REGION') ELSE to_nation END AS bl_port_of_discharge,
  concat(cnt, ' x 40''HC') AS si_container_count,
  CASE WHEN k % 23 = 0 THEN 'TBA' WHEN k % 5 = 0 THEN concat(cnt + 1, ' X 40''HC') WHEN k % 2 = 0 THEN concat(cnt, ' containers') ELSE concat(cnt, ' X 40''HC') END AS bl_container_count,
  concat(qty + 100, ',', lpad(CAST(k % 1000 AS STRING), 3, '0'), ' KG') AS si_gross_weight_kg,
  CASE WHEN k % 29 = 0 THEN concat(qty + 101, ',', lpad(CAST(k % 1000 AS STRING), 3, '0'), ' KG')
       WHEN k % 4 = 0 THEN concat(qty + 100, '.', lpad(CAST(k % 1000 AS STRING), 3, '0'), ' MT')
       WHEN k % 4 = 1 THEN concat(qty + 100, '.', lpad(CAST(k % 1000 AS STRING), 3, '0'), ' KGS')
       ELSE concat(CAST((qty + 100) * 1000 + k % 1000 AS STRING), '.2 kg') END AS bl_gross_weight_kg
FROM {ships}
"""
SIDES = _SIDES_OF.replace("{ships}", f"({SHIPMENTS}) ships")
EMAILS = """
SELECT concat('m', conv_id, '_', turn) AS email_id, conv_id, turn, CAST((conv_id * 31 + turn) % 12 AS BIGINT) AS n,
  CASE (conv_id * 31 + turn) % 12 WHEN 7 THEN 'RE: freight invoice 12' WHEN 10 THEN 'FW: RE_ Weekly note' ELSE concat('Shipment ', conv_id) END AS subject,
  concat(CASE WHEN turn % 4 = 1 THEN concat('WARNING: This email originated outside the company.', chr(10), chr(10)) ELSE '' END,
    'Dear team,', chr(10),
    CASE (conv_id * 31 + turn) % 12
      WHEN 0 THEN 'Claim your gift card now'
      WHEN 1 THEN 'Please compare the SI and the draft BL'
      WHEN 2 THEN concat('Shipping instruction for order', chr(10), 'POL : Busan', chr(10), 'Shipper : ACME')
      WHEN 3 THEN 'Please send us the draft BL'
      WHEN 4 THEN 'The invoice has the wrong THC'
      WHEN 5 THEN 'Vessel is two days late'
      WHEN 6 THEN 'Kindly check the draft BL against the SI'
      WHEN 8 THEN 'shipping instruction for this one: pol : lower case'
      WHEN 9 THEN 'GR for this lot is missing'
      ELSE 'All is well' END,
    chr(10), CASE WHEN turn % 5 = 0 THEN concat('Best regards,', chr(10), 'anna lee') ELSE 'thanks' END) AS body,
  CAST(turn % 3 AS INT) AS n_attachments
FROM {conversations}
"""


def sides(spark: SparkSession, folder: str) -> DataFrame:
    """:data:`SIDES`, its shipments dealt by ``k`` to all cores before any text is made of them: they are moved while they are small."""
    rows = read_table(spark, folder, "orders").count()  # the files' own counts; a shipment is an order
    return spark.sql(_SIDES_OF, ships=dealt(run(spark, folder, SHIPMENTS), "k", rows=rows))


#: Lines of a document: (number, text, condition); text and condition in SQL over SIDES.
_LINES = [
    (1, "CASE WHEN k % 9 = 0 THEN 'PACKING LIST' ELSE 'SHIPPING INSTRUCTION' END", "true"),
    (2, "concat(CASE WHEN k % 2 = 0 THEN 'Shipper' ELSE 'Shipper/Exporter' END, ': ', si_shipper)", "true"),
    (3, "'  12 HARBOUR ROAD'", "true"),
    (4, "concat(CASE WHEN k % 3 = 0 THEN 'To the Order of' ELSE 'CONSIGNEE' END, ': ', CASE WHEN k % 37 = 0 THEN '' ELSE si_consignee END)", "true"),
    (5, "'   ON BEHALF OF SOMEONE'", "k % 4 = 0"),
    (6, "concat('Notify Party  ', si_notify_party)", "true"),
    (7, "''", "true"),
    (8, "concat('Load Port: ', si_port_of_loading)", "k % 41 <> 0"),
    (9, "concat('POD: ', si_port_of_discharge)", "true"),
    (10, "concat('No. of Containers: ', si_container_count)", "true"),
    (11, "'NET WEIGHT: 1 KG'", "true"),
    (12, "concat('Gross Weight (KG): ', si_gross_weight_kg)", "true"),
    (13, "'Gross Weight: 1 KG'", "k % 6 = 0"),
]
#: The field that a line of these documents states.
FIELD_LINES = {2: "shipper", 4: "consignee", 6: "notify_party", 8: "port_of_loading", 9: "port_of_discharge", 10: "container_count", 12: "gross_weight_kg"}
LINES_TWIN = "WITH s AS MATERIALIZED (" + twin(SIDES) + ")\n" + "\nUNION ALL ".join(f"SELECT k AS doc_id, {n} AS line_no, {text} AS line FROM s WHERE {when}" for n, text, when in _LINES)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lines``: one document per shipment, written out line by line."""
    lines = ", ".join(f"CASE WHEN {when} THEN {text} END" for _, text, when in _LINES)
    return spark.sql(f"SELECT k AS doc_id, filter(array({lines}), x -> x IS NOT NULL) AS lines FROM {{sides}}", sides=sides(spark, folder))


_NUMBERED = ", ".join(f"named_struct('line_no', {n}, 'line', CASE WHEN {when} THEN {text} END)" for n, text, when in _LINES)


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lines``: the same documents, each line a struct ``line_no, line``."""
    return spark.sql(f"SELECT k AS doc_id, filter(array({_NUMBERED}), x -> x.line IS NOT NULL) AS lines FROM {{sides}}", sides=sides(spark, folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, line_no, line`` of the same documents, dealt by ``doc_id``: no step by it moves a line."""
    return spark.sql(f"SELECT k AS doc_id, inline(array({_NUMBERED})) FROM {{sides}}", sides=sides(spark, folder)).where("line IS NOT NULL")
