"""Explicit schemas and enum orders of the briefing's fifteen tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enum labels in declaration order, which is their sort order.
ENUMS: dict[str, tuple[str, ...]] = {
    "market_type": ("US", "KR"),
    "page_status": ("READY", "PARTIAL", "FAILED"),
    "job_status": ("PENDING", "RUNNING", "SUCCESS", "PARTIAL", "FAILED"),
    "trigger_type": ("SCHEDULED", "MANUAL", "ADMIN_REBUILD"),
    "summary_status": ("SUCCESS", "FAILED", "FALLBACK"),
    "summary_type": ("GLOBAL_HEADLINE", "MARKET_SUMMARY", "CLUSTER_CARD_SUMMARY", "CLUSTER_DETAIL_ANALYSIS"),
    "event_level": ("INFO", "WARN", "ERROR"),
}


def enum_order(column: Column | str, labels: tuple[str, ...]) -> Column:
    """Place of a label in its declaration; null for other values."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(F.lit(False), 0)
    for k, label in enumerate(labels, 1):
        out = out.when(c == label, k)
    return out


def market_order(column: Column | str = "market_type") -> Column:
    return enum_order(column, ENUMS["market_type"])


_PRICE, _PERCENT = T.DecimalType(20, 4), T.DecimalType(10, 4)
_TEXTS = T.ArrayType(T.StringType())
_SHORT = {
    "id": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "text": T.StringType(), "flag": T.BooleanType(),
    "date": T.DateType(), "time": T.TimestampType(), "price": _PRICE, "percent": _PERCENT, "texts": _TEXTS,
}


def _table(spec: str) -> T.StructType:
    """``name:type`` pairs; a trailing ? marks a nullable column."""
    fields = []
    for item in spec.split():
        name, kind = item.rstrip("?").split(":")
        fields.append(T.StructField(name, _SHORT[kind], item.endswith("?")))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "batch_job": _table(
        "job_id:id job_name:text business_date:date status:text trigger_type:text triggered_by_user_id:text? force_run:flag rebuild_page_only:flag "
        "started_at:time ended_at:time? duration_seconds:int? market_scope:text raw_news_count:int processed_news_count:int cluster_count:int "
        "page_id:id? page_version_no:int? partial_message:text? error_code:text? error_message:text? log_summary:text? created_at:time updated_at:time"
    ),
    "batch_job_event": _table("id:id batch_job_id:id step_code:text level:text message:text context_json:text? created_at:time"),
    "news_search_keyword": _table(
        "id:id provider_name:text market_type:text keyword:text is_active:flag priority:int created_at:time updated_at:time"
    ),
    "news_article_raw": _table(
        "id:id provider_name:text provider_article_key:text market_type:text business_date:date search_keyword:text? title:text publisher_name:text? "
        "published_at:time? origin_link:text? naver_link:text? payload_json:text collected_at:time created_at:time"
    ),
    "news_article_processed": _table(
        "id:id business_date:date market_type:text dedupe_hash:text canonical_title:text publisher_name:text? published_at:time? origin_link:text "
        "naver_link:text? source_summary:text? article_body_excerpt:text? content_json:text created_at:time updated_at:time"
    ),
    "news_article_raw_processed_map": _table("raw_article_id:id processed_article_id:id created_at:time"),
    "news_cluster": _table(
        "id:id cluster_uid:text business_date:date market_type:text cluster_rank:int title:text summary_short:text? summary_long:text? "
        "analysis_paragraphs_json:texts tags_json:texts representative_article_id:id article_count:int created_at:time updated_at:time"
    ),
    "news_cluster_article": _table("cluster_id:id processed_article_id:id article_rank:int created_at:time"),
    "market_index_daily": _table(
        "id:id business_date:date market_type:text index_code:text index_name:text close_price:price change_value:price change_percent:percent "
        "high_price:price? low_price:price? currency_code:text provider_name:text collected_at:time created_at:time"
    ),
    "ai_summary": _table(
        "id:id batch_job_id:id summary_type:text business_date:date market_type:text? cluster_id:id? title:text? body:text? paragraphs_json:texts "
        "model_name:text? prompt_version:text? status:text fallback_used:flag error_message:text? metadata_json:text generated_at:time"
    ),
    "market_daily_page": _table(
        "id:id business_date:date version_no:int page_title:text status:text global_headline:text? partial_message:text? raw_news_count:int "
        "processed_news_count:int cluster_count:int batch_job_id:id? metadata_json:text generated_at:time last_updated_at:time"
    ),
    "market_daily_page_market": _table(
        "id:id page_id:id market_type:text display_order:short market_label:text summary_title:text? summary_body:text? "
        "analysis_background_json:texts analysis_key_themes_json:texts analysis_outlook:text? raw_news_count:int processed_news_count:int "
        "cluster_count:int last_updated_at:time partial_message:text? metadata_json:text"
    ),
    "market_daily_page_market_index": _table(
        "id:id page_market_id:id market_index_daily_id:id? display_order:short index_code:text index_name:text close_price:price change_value:price "
        "change_percent:percent high_price:price? low_price:price? currency_code:text"
    ),
    "market_daily_page_market_cluster": _table(
        "id:id page_market_id:id cluster_id:id? cluster_uid:text display_order:short title:text summary:text? article_count:int tags_json:texts "
        "representative_article_id:id? representative_title:text? representative_publisher_name:text? representative_origin_link:text? "
        "representative_naver_link:text? representative_published_at:time?"
    ),
    "market_daily_page_article_link": _table(
        "id:id page_market_id:id display_order:int processed_article_id:id? cluster_id:id? cluster_uid:text? cluster_title:text? title:text "
        "publisher_name:text? published_at:time? origin_link:text naver_link:text?"
    ),
}
