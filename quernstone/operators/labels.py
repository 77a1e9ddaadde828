"""Label, id and property conventions of graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Older label spellings and the ones used now.
LABEL_MAPPING = {
    "MonHoc": "MON_HOC", "QuyDinh": "QUY_DINH", "DieuKien": "DIEU_KIEN", "Khoa": "KHOA", "Nganh": "NGANH",
    "ChuongTrinhDaoTao": "CHUONG_TRINH_DAO_TAO", "SinhVien": "SINH_VIEN", "KyHoc": "KY_HOC", "GiangVien": "GIANG_VIEN",
    "HocPhi": "HOC_PHI",
}

# Prefixes taken off ids, tried in this order.
ID_PREFIXES = ["MON_HOC_", "KHOA_", "NGANH_", "QUY_DINH_", "DIEU_KIEN_"]

# Per label the id property, the name property and the required ones.
PROPERTY_KEYS = {
    "MON_HOC": ("ma_mon", "ten_mon", ["ma_mon", "ten_mon", "so_tin_chi"]),
    "KHOA": ("ma_khoa", "ten_khoa", ["ma_khoa", "ten_khoa"]),
    "NGANH": ("ma_nganh", "ten_nganh", ["ma_nganh", "ten_nganh"]),
    "QUY_DINH": ("ma_quy_dinh", "tieu_de", ["ma_quy_dinh", "tieu_de"]),
    "DIEU_KIEN": ("ma_dieu_kien", "mo_ta", ["ma_dieu_kien", "mo_ta"]),
}

# Required properties that are numbers, where zero counts as missing.
COUNT_PROPERTIES = ["so_tin_chi"]

# Node categories of the graph.
CATEGORIES = [
    "MON_HOC", "KHOA", "NGANH", "CHUONG_TRINH_DAO_TAO", "SINH_VIEN", "KY_HOC", "GIANG_VIEN", "QUY_DINH", "DIEU_KIEN",
    "CHUNG_CHI", "DIEM_SO", "DO_KHO", "DOI_TUONG", "TAI_CHINH", "DIEU_KIEN_SO", "HOC_PHI",
]

# Edge types of the graph.
EDGE_TYPES = [
    "THUOC_KHOA", "CUA_NGANH", "THUOC_CHUONG_TRINH", "QUAN_LY", "THUOC_VE", "DIEU_KIEN_TIEN_QUYET", "YEU_CAU_DIEU_KIEN",
    "QUY_DINH_DIEU_KIEN", "YEU_CAU", "AP_DUNG_CHO", "CHI_PHOI", "LIEN_QUAN_NOI_DUNG", "THAY_THE", "BO_SUNG", "TUONG_DUONG",
    "DAT_DIEM", "MIEN_GIAM", "AMENDS", "REPLACES", "SUPPLEMENTS", "REPEALS", "HOC_TRONG", "DAY", "LIEN_QUAN", "QUY_DINH_KHAC",
]

# Types accepted from extraction.
ENTITY_TYPES = [
    "MON_HOC", "QUY_DINH", "DIEU_KIEN", "SINH_VIEN", "KHOA", "KY_HOC", "HOC_PHI", "DIEM_SO", "TIN_CHI", "THOI_GIAN", "NGANH",
    "CHUONG_TRINH_DAO_TAO", "GIANG_VIEN", "CHUNG_CHI", "DO_KHO", "DOI_TUONG", "TAI_CHINH", "DIEU_KIEN_SO", "VAN_BAN", "SO_LUONG",
    "MUC_PHI", "DIEU_KHOAN",
]
RELATION_TYPES = [
    "YEU_CAU", "DIEU_KIEN_TIEN_QUYET", "AP_DUNG_CHO", "QUY_DINH_DIEU_KIEN", "THUOC_KHOA", "HOC_TRONG", "YEU_CAU_DIEU_KIEN",
    "LIEN_QUAN_NOI_DUNG", "CUA_NGANH", "THUOC_CHUONG_TRINH", "QUAN_LY", "DAT_DIEM", "TUONG_DUONG", "MIEN_GIAM", "CHI_PHOI",
    "THUOC_VE", "GIOI_HAN", "SUA_DOI", "THAY_THE", "BO_SUNG", "BAI_BO",
]


def _lookup(col: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def standardize_label(label: Column, mapping: dict[str, str] | None = None) -> Column:
    """UPPER_SNAKE label: a known spelling is mapped, anything else upper-cased."""
    return F.coalesce(_lookup(label, mapping or LABEL_MAPPING), F.upper(label))


def clean_id(value: Column) -> Column:
    """Id without its label prefix, parentheses and outer underscores."""
    bare = F.regexp_replace(value, "^(" + "|".join(ID_PREFIXES) + ")", "")
    return F.regexp_replace(F.regexp_replace(bare, "[()]", ""), "^_+|_+$", "")


def _key(label: Column, place: int, default: str) -> Column:
    return F.coalesce(_lookup(label, {k: v[place] for k, v in PROPERTY_KEYS.items()}), F.lit(default))


def _filled(col: Column) -> Column:
    return F.when(col != "", col)


def standardize_props(nodes: DataFrame) -> DataFrame:
    """Standard label and property names; ``nodes``: (..., label, props MAP<STRING,STRING>).

    The id comes from the label's key, code, id or name, the display name from its key,
    name, title or the id. Those old keys go, other properties stay.
    """
    p = F.col("props")
    get = lambda k: _filled(F.element_at(p, k if isinstance(k, Column) else F.lit(k)))
    step = nodes.withColumn("label", standardize_label(F.col("label")))
    step = step.withColumns({"_idk": _key(F.col("label"), 0, "id"), "_namek": _key(F.col("label"), 1, "name")})
    step = step.withColumn("_id", clean_id(F.coalesce(get(F.col("_idk")), get("code"), get("id"), get("name"))))
    step = step.withColumn("_name", F.coalesce(get(F.col("_namek")), get("name"), get("title"), F.col("_id")))
    rest = F.map_filter(
        p, lambda k, v: ~k.isin("code", "id", "name", "title") & (k != F.col("_idk")) & (k != F.col("_namek"))
    )
    return step.withColumn(
        "props", F.map_concat(rest, F.map_from_arrays(F.array("_idk", "_namek"), F.array("_id", "_name")))
    ).drop("_idk", "_namek", "_id", "_name")


def standardize_entities(entities: DataFrame, default_credits: str = "4") -> DataFrame:
    """Extracted entities in property form; ``entities``: (..., text, name, type, metadata MAP).

    Courses take credits, title and description from the metadata, and a default credit count.
    """
    step = entities.withColumn("label", standardize_label(F.col("type"))).withColumn("_id", clean_id(F.col("text")))
    step = step.withColumns({"_idk": _key(F.col("label"), 0, "id"), "_namek": _key(F.col("label"), 1, "name")})
    m = lambda k: F.element_at("metadata", F.lit(k))
    course = F.col("label") == "MON_HOC"
    name = F.coalesce("name", "_id")
    base = F.array(
        F.struct(F.col("_idk").alias("k"), F.col("_id").alias("v")),
        F.struct(F.col("_namek").alias("k"), F.when(course, F.coalesce(m("title"), name)).otherwise(name).alias("v")),
        F.struct(F.lit("so_tin_chi").alias("k"), F.when(course, F.coalesce(m("credits"), F.lit(default_credits))).alias("v")),
        F.struct(F.lit("mo_ta").alias("k"), F.when(course, m("description")).alias("v")),
    )
    # A label whose name key is also a course key keeps one entry of it.
    pairs = F.filter(base, lambda x: x["v"].isNotNull())
    return step.withColumn("props", F.map_from_entries(pairs)).drop("_id", "_idk", "_namek")


def validate_props(nodes: DataFrame) -> DataFrame:
    """Adds ``missing`` (required properties absent, empty, or a zero count) and ``is_valid``."""
    required = F.element_at(
        F.create_map(*[x for k, v in PROPERTY_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v[2]]))]),
        standardize_label(F.col("label")),
    )
    missing = F.filter(
        F.coalesce(required, F.expr("cast(array() as array<string>)")),
        lambda r: (F.coalesce(F.element_at("props", r), F.lit("")) == "") | (r.isin(COUNT_PROPERTIES) & (F.element_at("props", r) == "0")),
    )
    return nodes.withColumn("missing", missing).withColumn("is_valid", F.size("missing") == 0)


def to_graph_models(articles: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): articles as regulations, entities by category, unknown types on their fallbacks."""
    props = lambda **kv: F.map_from_entries(
        F.filter(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in kv.items()]), lambda x: x["v"].isNotNull())
    )
    nodes = articles.select(
        "id", F.lit("QUY_DINH").alias("label"), props(title=F.col("title"), full_text=F.col("full_text"), source=F.lit("legal_doc")).alias("props")
    ).unionByName(entities.select(
        "id", F.when(F.col("type").isin(CATEGORIES), F.col("type")).otherwise("DIEU_KIEN").alias("label"),
        props(text=F.col("text"), normalized=F.col("normalized"), source_article=F.col("source_article_id")).alias("props"),
    ))
    edges = relations.select(
        F.col("source_id").alias("src"), F.col("target_id").alias("dst"),
        F.when(F.col("type").isin(EDGE_TYPES), F.col("type")).otherwise("LIEN_QUAN_NOI_DUNG").alias("type"),
        props(evidence=F.col("evidence")).alias("props"),
    )
    return nodes, edges
