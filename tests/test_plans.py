"""What building a plan does: nothing runs before the query does."""

import pytest

import __spark_entry__ as entry

BUILT = [
    "address_book", "tracking_timeline", "document_number", "order_document", "purchase_document", "invoice_document", "invoice_text",
    "admin_order_list", "customer_order_list", "user_orders", "order_header_detail", "user_order_history", "delivery_order_detail",
    "invoice_header", "nested_order_scan", "cart_merge", "default_address_set", "profile_update", "purchase_replace_lines",
    "purchase_item_cancel", "purchase_cancel_lines", "order_cancel_ledger", "order_state_apply_payments", "apply_coupon", "checkout_price",
    "bulk_item_load_products", "category_product_load_products", "purchase_post_headers", "otp_match", "flash_sale_orders",
    "order_fanout_ledger", "order_fanout_coupon_usage", "paged_sort", "paged_sort_after",
]


@pytest.mark.parametrize("name", BUILT)
def test_building_starts_no_job(spark, data, name):
    group = f"building-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry.queries()[name](spark, data)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
