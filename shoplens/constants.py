"""Fixed values the operators must share with the behaviour they reproduce.

Everything here is plain data: status vocabularies, code maps, header aliases,
bucket edges and labels.  Keep each table in its natural order -- several rules
("first alias wins", "first bucket that matches") depend on that order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Standard-model vocabularies
# ---------------------------------------------------------------------------
PLATFORMS = ["douyin", "taobao", "tiktok", "manual"]
ORDER_STATUSES = ["paid", "shipped", "completed", "refunded"]
REFUNDED = "refunded"

# ---------------------------------------------------------------------------
# Platform A status (matched lower-cased, unknown -> paid)
# ---------------------------------------------------------------------------
PLATFORM_A_STATUS = {
    "unpaid": "paid",
    "on_hold": "paid",
    "awaiting_shipment": "paid",
    "awaiting_collection": "paid",
    "in_transit": "shipped",
    "delivered": "completed",
    "completed": "completed",
    "cancelled": "refunded",
    "refund": "refunded",
    "refunded": "refunded",
}

# ---------------------------------------------------------------------------
# Platform B status (case-sensitive, missing/unknown -> paid)
# ---------------------------------------------------------------------------
PLATFORM_B_STATUS = {
    "PAID": "paid",
    "DELIVERING": "shipped",
    "DELIVERED": "shipped",
    "COMPLETED": "completed",
    "SETTLEMENT": "completed",
    "REFUND": "refunded",
    "PART_REFUND": "refunded",
    "CANCEL": "refunded",
}

# ---------------------------------------------------------------------------
# Influencer feed code maps (default US / en)
# ---------------------------------------------------------------------------
SITE_CODES = {"US": "US", "TH": "TH", "MY": "MY", "us": "US", "th": "TH", "my": "MY"}
DEFAULT_SITE = "US"
LANGUAGES = {"en": "en", "th": "th", "id": "id", "English": "en", "Thai": "th", "Indonesian": "id"}
DEFAULT_LANGUAGE = "en"

# ---------------------------------------------------------------------------
# Display labels
# ---------------------------------------------------------------------------
STATUS_LABELS = {
    "completed": "已完成",
    "shipped": "已发货",
    "paid": "已付款",
    "refunded": "已退款/取消",
}
ORDER_TYPE_LABELS = {"sample": "样品单", "cod": "货到付款", "normal": "普通订单"}
UNKNOWN_PROVIDER = "未知"
UNKNOWN_PLATFORM = "未知"
DEFAULT_SHOP_NAME = "默认店铺"
UNCATEGORISED = "未分类"

# ---------------------------------------------------------------------------
# Analysis radar keys (only these six survive normalisation)
# ---------------------------------------------------------------------------
RADAR_LABELS = {
    "fan_quality": "粉丝质量",
    "content_relevance": "内容契合度",
    "product_fit": "货品匹配度",
    "conversion_potential": "转化潜力",
    "cost_efficiency": "投放性价比",
    "risk_control": "风控健康度",
}

# ---------------------------------------------------------------------------
# Bucket edges (lower inclusive, upper exclusive) and labels
# ---------------------------------------------------------------------------
ROI_BUCKETS = [("0-1", None, 1.0), ("1-3", 1.0, 3.0), ("3-5", 3.0, 5.0), ("5+", 5.0, None)]
UPLOAD_ROI_BUCKETS = [
    ("低于1（亏损）", None, 1.0),
    ("1到3", 1.0, 3.0),
    ("3到5", 3.0, 5.0),
    ("5以上", 5.0, None),
]
PRICE_BANDS = [("0-10", 0.0, 10.0), ("10-20", 10.0, 20.0), ("20-50", 20.0, 50.0), ("50+", 50.0, None)]
PRICE_DISTRIBUTION = [
    ("0-500", 0.0, 500.0),
    ("500-1000", 500.0, 1000.0),
    ("1000-2000", 1000.0, 2000.0),
    ("2000+", 2000.0, None),
]

# ---------------------------------------------------------------------------
# HTML payload prefixes that mark a feed page as not-data
# ---------------------------------------------------------------------------
HTML_PREFIXES = ["<!doctype", "<html", "<head", "<body"]

# ---------------------------------------------------------------------------
# Upload header aliases, canonical name -> aliases (first wins)
# ---------------------------------------------------------------------------
COLUMN_ALIASES = {
    "gmv": ["gmv", "销售额", "成交金额", "支付金额", "总收入", "gross revenue", "total sales", "revenue"],
    "orders": ["orders", "订单数", "订单量", "成交订单数", "支付订单数", "total orders", "units sold", "销量"],
    "date": ["date", "日期", "统计日期", "下单日期", "时间", "order date"],
    "product": ["product", "商品名称", "商品名", "商品标题", "product name", "sku名称", "item name"],
    "visitors": ["visitors", "访客数", "浏览人数", "uv", "views", "曝光量", "page views", "商品访客数"],
    "conversion": ["conversion", "转化率", "支付转化率", "点击转化率", "conversion rate", "cvr"],
    "creator": ["creator", "达人昵称", "达人名称", "达人", "creator name", "kol", "influencer", "username", "账号昵称"],
    "roi": ["roi", "投产比", "投入产出比", "roas"],
    "commission": ["commission", "佣金率", "佣金比例", "commission rate"],
    "videos": ["videos", "视频数", "带货视频数", "发布视频数", "video count"],
    "followers": ["followers", "粉丝数", "粉丝量", "follower count", "粉丝数量"],
    "cost": ["cost", "花费", "投放金额", "成本", "spend", "样品成本"],
}

# ---------------------------------------------------------------------------
# Period label of a report (all rows; both bounds; first only; last only)
# ---------------------------------------------------------------------------
PERIOD_ALL = "全部数据"
PERIOD_BOTH = "%s 至 %s"
PERIOD_FROM = "%s 至今"
PERIOD_UPTO = "截至 %s"

# ---------------------------------------------------------------------------
# Upload limits, rule thresholds, benchmark ranges
# ---------------------------------------------------------------------------
# Upload encodings tried in order.
UPLOAD_ENCODINGS = ["utf-8-sig", "utf-8", "gbk", "gb18030"]
UPLOAD_SUFFIXES = [".csv", ".xlsx", ".xls"]
UPLOAD_MAX_BYTES = 50 * 1024 * 1024

# Suspicious-influencer rule defaults (engagement and conversion in percent).
SUSPICIOUS_MIN_ENGAGEMENT = 20.0
SUSPICIOUS_MAX_CONVERSION = 0.5

# Marketing benchmark ranges quoted to analysts (percent).
CONVERSION_BENCHMARK = (1.5, 3.0)
PRODUCING_RATE_BENCHMARK = (10.0, 20.0)
