"""Independent SQL answers to the read queries."""

from oracle.views import answer

SQL: dict[str, str] = {}


def put(name: str, shape: str, body: str) -> None:
    SQL[name] = answer(shape, body)


# --- sources and predicates

put("tenant_scan", "user_id:i register_id:i store_name:s",
    "select u.user_id, u.register_id, t.store_name from v_users u join v_tenants t using (register_id)")
put("table_source", "s_suppkey:i s_name:s s_nationkey:i", "select s_suppkey, s_name, s_nationkey from supplier")
put("title_search", "product_id:i title:s",
    "select product_id, title from v_products where lower(title) like lower('%re_ %')")
put("purchase_search", "purchaseid:i purchase_no:s purchasedate:D", """
    select purchaseid, purchase_no, purchasedate from v_purchases
    where (purchase_no ilike '%1%' or coalesce(refrence, '') ilike '%1%')
    and purchasedate >= date '1997-02-01' and purchasedate <= date '1998-06-30'""")
put("category_filter", "categories_id:i categories_name:s cat_sts:i", "select * from v_categories")
put("unit_list", "unitid:i unitname:s unitshortcode:s", "select * from v_units")
put("active_coupons", "coupon_id:i coupon_code:s expiry_date:D", """
    select coupon_id, coupon_code, expiry_date from v_coupons
    where is_active and coalesce(expiry_date, date '9999-01-01') >= date '2001-07-31'""")
put("status_label", "product_id:i status:s",
    "select product_id, case itmsts when 1 then 'Active' else 'In-Active' end status from v_products")
put("order_bucket", "order_id:i bucket:s exact_bucket:s", """
    select order_id,
        case when lower(order_status) in ('pending', 'process', 'out_for_delivery') then 'processed' else order_status end bucket,
        case order_status when 'Pending' then 'processed' when 'Process' then 'processed'
            when 'delivered' then 'delivered' when 'cancelled' then 'cancelled' end exact_bucket
    from v_orders""")
put("product_options", "item_id:i item_name:s unit_id:i unit_name:s rate:d", """
    select product_id item_id, title item_name, unitid unit_id, unitname unit_name, price rate
    from v_products join v_units on unit = unitid""")
put("normalize_order_id", "order_no:s number:i",
    "select order_no, cast(substr(order_no, 4) as bigint) number from v_orders")
put("row_validation_addresses", "address_id:i reason:s", """
    select address_id, case when address_id % 9 = 0 then 'Name is required'
        when address_id % 5 <> 0 and address_id % 7 = 0 then 'Phone number is required'
        when address_id % 5 = 0 then 'Phone number must be exactly 10 digits' end reason from v_addresses""")
put("row_validation_orders", "order_id:i reason:s", """
    select order_id, case when order_id % 6 = 0 then 'Please add or select a delivery address before placing order'
        when order_id % 7 = 0 then 'Delivery end time missing'
        when order_id % 5 = 0 then 'Delivery time required' end reason from v_orders""")
put("row_validation_items", "product_id:i reason:s", """
    select product_id, case when product_id % 4 = 0 then 'Item name is required'
        when product_id % 5 = 0 then 'Category is required' when unit = 3 then 'Unit is required' end reason
    from v_products""")
put("row_validation_coupons", "coupon_id:i reason:s", """
    select coupon_id, case when coupon_id % 4 = 0 then 'Coupon code, type and value are required'
        when coupon_id % 5 = 0 then 'Invalid discount type' end reason from v_coupons""")

# --- stock

put("stock_ledger", "product_id:i title:s lowstqty:i itmsts:i openbalqty:i stock:i", "select * from v_stock")

REPORT = """
    select p.product_id, p.title, p.openbalqty, coalesce(i.q, 0) in_qty, coalesce(o.q, 0) out_qty,
        p.openbalqty + coalesce(i.q, 0) - coalesce(o.q, 0) current_stock
    from v_products p
    left join (select itmid, sum(stockqty) q from v_ledger join v_products on product_id = itmid
        where itmcandel = 0 and instoreid > 0 and purchase_date >= coalesce(openbaldate, date '1995-01-01')
        group by 1) i on i.itmid = p.product_id
    left join (select itmid, sum(stockqty) q from v_ledger join v_products on product_id = itmid
        where itmcandel = 0 and outstoreid > 0 and purchase_date >= coalesce(openbaldate, date '1995-01-01')
        group by 1) o on o.itmid = p.product_id"""
REPORT_SHAPE = "product_id:i title:s openbalqty:i in_qty:i out_qty:i current_stock:i"
put("stock_report", REPORT_SHAPE, REPORT)
put("stock_report_in", REPORT_SHAPE, f"select * from ({REPORT}) r where current_stock > 0")
put("stock_report_out", REPORT_SHAPE, f"select * from ({REPORT}) r where current_stock = 0")
put("stock_state_filter", "product_id:i title:s lowstqty:i itmsts:i openbalqty:i stock:i",
    "select * from v_stock where itmsts = 1 and stock <= 0")
LOW = """
    select s.product_id id, s.title "name", s.lowstqty, s.itmsts, s.stock, coalesce(m.image_url, '') image
    from v_stock s left join v_item_image m using (product_id)
    where s.itmsts = 1 and s.stock > 0 and s.stock <= coalesce(s.lowstqty, 0)"""
LOW_SHAPE = "id:i name:s lowstqty:i itmsts:i stock:i image:s"
put("low_stock_list", LOW_SHAPE, LOW)
put("low_stock_page", LOW_SHAPE,
    f"select * from ({LOW}) r where \"name\" ilike '%ring%' order by id desc limit 15 offset 15")
put("low_stock_total", "total:i", f"select count(*) total from ({LOW}) r where \"name\" ilike '%ring%'")
TOP_LOW = """
    select s.product_id id, s.title "name", s.lowstqty, s.itmsts, s.openbalqty, s.stock, coalesce(m.image_url, '') image
    from v_stock s left join v_item_image m using (product_id)
    where s.itmsts = 1 and s.openbalqty + s.stock > 0 and s.openbalqty + s.stock <= coalesce(s.lowstqty, 0)
    order by s.stock desc, s.product_id limit 5"""
put("dashboard_low_stock", "id:i name:s lowstqty:i itmsts:i openbalqty:i stock:i image:s", TOP_LOW)
put("first_image_per_product", "product_id:i image_url:s",
    "select distinct on (product_id) product_id, image_url from v_images order by product_id, image_url")

# --- sales

PAID = "payment_status = 'complete' and order_status <> 'cancelled'"
put("sales_week", "name:s sales:d day:D", f"""
    select strftime(cast(created_at as date), '%a') "name", sum(total_amount) sales, cast(created_at as date) "day"
    from v_orders where cast(created_at as date) between date '2001-07-25' and date '2001-07-31' and {PAID}
    group by cast(created_at as date)""")
put("sales_month", "name:s sales:d", f"""
    select 'Week ' || cast(floor((extract(day from created_at) - 1) / 7) + 1 as int) "name", sum(total_amount) sales
    from v_orders where date_trunc('month', created_at) = date '2001-07-01' and {PAID} group by 1""")
put("sales_year", "name:s sales:d month:D", f"""
    select strftime(created_at, '%b') "name", sum(total_amount) sales,
        cast(date_trunc('month', created_at) as date) "month"
    from v_orders where extract(year from created_at) = 2000 and {PAID} group by 1, 3""")
put("chart_gap_fill_week", "position:i name:s sales:d", f"""
    select s."position", s."name", coalesce(sum(total_amount), 0) sales
    from (values (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun')) s("position", "name")
    left join v_orders o on strftime(o.created_at, '%a') = s."name" and {PAID}
        and cast(created_at as date) between date '2001-07-25' and date '2001-07-31' group by 1, 2""")
put("chart_gap_fill_month", "position:i name:s sales:d", f"""
    select n - 1 "position", 'Week ' || n "name", coalesce(sum(total_amount), 0) sales
    from (values (1), (2), (3), (4), (5)) s(n)
    left join v_orders o on (extract(day from o.created_at) - 1) // 7 + 1 = n and {PAID}
        and date_trunc('month', created_at) = date '1999-02-01' group by n""")
put("chart_gap_fill_year", "position:i name:s sales:d", f"""
    select n - 1 "position", strftime(make_date(2001, n, 1), '%b') "name", coalesce(sum(total_amount), 0) sales
    from (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) s(n)
    left join v_orders o on extract(month from o.created_at) = n and extract(year from o.created_at) = 2001 and {PAID}
    group by n""")
put("revenue_graph", "label:s value:d first_at:t", """
    select strftime(created_at, '%d %b') label, sum(total_amount) "value", min(created_at) first_at from v_orders
    where created_at >= timestamp '2001-08-01 09:30:00' - interval 7 day group by 1""")
put("dashboard_totals", "total_orders:i total_revenue:d pending_orders:i", """
    select (select count(*) from v_orders) total_orders,
        (select coalesce(sum(total_amount), 0) from v_orders where payment_status = 'complete') total_revenue,
        (select count(*) from v_orders where order_status in ('Pending', 'Process')) pending_orders""")
SUMMARY_COLUMNS = ("today_orders", "today_revenue", "today_pending",
                   "yesterday_orders", "yesterday_revenue", "yesterday_pending")


def summary(day: str, yesterday: str) -> str:
    columns = []
    for name, d in (("today", day), ("yesterday", yesterday)):
        on = f"cast(created_at as date) = date '{d}'"
        columns += [
            f"count(*) filter (where {on} and order_status <> 'cancelled') {name}_orders",
            f"sum(total_amount) filter (where {on} and {PAID}) {name}_revenue",
            f"count(*) filter (where {on} and order_status = 'Pending') {name}_pending",
        ]
    return f"select {', '.join(columns)} from v_orders"


put("today_vs_yesterday", "today_orders:i today_revenue:d today_pending:i"
    " yesterday_orders:i yesterday_revenue:d yesterday_pending:i", summary("2001-07-15", "2001-07-14"))
FIGURES = " union all ".join(
    f"select 'summary' part, '{c}' \"name\", cast({c} as double) \"value\" from ({summary('2001-07-31', '2001-07-30')}) s"
    for c in SUMMARY_COLUMNS)
put("dashboard_bundle", "part:s name:s value:d", f"""
    {FIGURES}
    union all select 'low_stock', cast(id as varchar), cast(stock as double) from ({TOP_LOW}) l
    union all select 'chart', 'Week ' || ((extract(day from created_at) - 1) // 7 + 1), cast(sum(total_amount) as double)
        from v_orders where date_trunc('month', created_at) = date '2001-07-01' and {PAID} group by 2""")

SOLD = f"(select * from v_orders join v_users using (user_id) where {PAID})"
put("sales_year_by_store", "register_id:i name:s sales:d month:D", f"""
    select register_id, strftime(m, '%b') "name", sales, cast(m as date) "month"
    from (select register_id, date_trunc('month', created_at) m, sum(total_amount) sales from {SOLD} s
          where created_at >= timestamp '2000-01-01' and created_at < timestamp '2001-01-01' group by 1, 2) r""")
put("chart_gap_fill_by_store", "register_id:i position:i name:s sales:d", f"""
    select r.register_id, n "position", strftime(date '2001-07-23' + n, '%a') "name",
        coalesce((select sum(total_amount) from {SOLD} s where s.register_id = r.register_id
            and cast(created_at as date) between date '2001-07-25' and date '2001-07-31'
            and strftime(created_at, '%a') = strftime(date '2001-07-23' + n, '%a')), 0) sales
    from v_tenants r,
        (values (0), (1), (2), (3), (4), (5), (6)) d(n)""")
put("revenue_graph_by_store", "register_id:i label:s value:d first_at:t", """
    select register_id, strftime(created_at, '%d %b') label, sum(total_amount) "value", min(created_at) first_at
    from v_orders join v_users using (user_id)
    where created_at >= timestamp '2001-08-01 09:30:00' - interval 7 day group by 1, 2""")
put("dashboard_totals_by_store", "register_id:i total_orders:i total_revenue:d pending_orders:i", """
    select s.register_id, count(order_id) total_orders,
        coalesce(sum(total_amount) filter (where payment_status = 'complete'), 0) total_revenue,
        count(*) filter (where order_status in ('Pending', 'Process')) pending_orders
    from v_tenants s left join (select * from v_orders join v_users using (user_id)) o on o.register_id = s.register_id
    group by 1""")
put("today_vs_yesterday_by_store", "register_id:i today_orders:i today_revenue:d today_pending:i"
    " yesterday_orders:i yesterday_revenue:d yesterday_pending:i", "select s.register_id, " + ", ".join(
        f"coalesce({c}, 0) {c}" for c in SUMMARY_COLUMNS) + " from v_tenants s left join ("
    + summary("2001-07-15", "2001-07-14").replace("select ", "select register_id, ", 1).replace(
        "from v_orders", "from v_orders join v_users using (user_id) group by register_id") + ") f on f.register_id = s.register_id")

# --- orders and people

ADMIN = """
    select r.order_id, r.order_no, r.total_amount, r.order_status, r.payment_status, d.delivery_mode, t."name",
        strftime(r.delivery_start, '%Y-%m-%d %H:%M:%S') delivery_start,
        strftime(r.delivery_end, '%Y-%m-%d %H:%M:%S') delivery_end, coalesce(sum(i.product_qty), 0) item_count,
        r.created_at
    from v_orders r join v_delivery_modes d using (delivery_id)
    left join v_address_last t on t.user_id = r.user_id
    left join v_order_items i on i.order_id = r.order_id
    group by all"""
ADMIN_SHAPE = ("order_id:i order_no:s total_amount:d order_status:s payment_status:s delivery_mode:s name:s"
               " delivery_start:s delivery_end:s item_count:i")
put("admin_order_list", ADMIN_SHAPE, ADMIN)
put("paged_sort", ADMIN_SHAPE, f"select * from ({ADMIN}) r order by created_at desc, order_id desc limit 20 offset 40")
LAST_SEEN = "(created_at < timestamp '1994-03-05' or (created_at = timestamp '1994-03-05' and order_id < 3000))"
put("paged_sort_after", ADMIN_SHAPE,
    f"select * from ({ADMIN}) r where {LAST_SEEN} order by created_at desc, order_id desc limit 20")
CUSTOMER_ORDERS = """
    select o.order_id, o.order_no, o.total_amount, o.order_status, o.payment_status, r.rating, o.created_at,
        a."name" customer_name, coalesce(sum(i.product_qty), 0) item_count
    from v_orders o left join v_order_items i on o.order_id = i.order_id
    left join v_address_last a on a.user_id = o.user_id left join v_reviews r on r.user_id = o.user_id group by all"""
CUSTOMER_ORDERS_SHAPE = ("order_id:i order_no:s total_amount:d order_status:s payment_status:s rating:i created_at:t"
                         " customer_name:s item_count:i")
put("customer_order_list", CUSTOMER_ORDERS_SHAPE, CUSTOMER_ORDERS)
put("customer_order_page", CUSTOMER_ORDERS_SHAPE,
    f"select * from ({CUSTOMER_ORDERS}) r order by created_at desc, order_id desc limit 20")
put("customer_order_after", CUSTOMER_ORDERS_SHAPE,
    f"select * from ({CUSTOMER_ORDERS}) r where {LAST_SEEN} order by created_at desc, order_id desc limit 20")
put("user_orders", "order_id:i user_id:i order_no:s total_amount:d order_status:s payment_status:s bucket:s name:s"
    " item_count:i", """
    select o.order_id, o.user_id, o.order_no, o.total_amount, o.order_status, o.payment_status,
        case when o.order_status in ('Pending', 'out_for_delivery') then 'processed' else o.order_status end bucket,
        a."name", coalesce(sum(i.product_qty), 0) item_count
    from v_orders o left join v_order_items i on o.order_id = i.order_id
    left join v_addresses a on a.user_id = o.user_id group by all""")
put("user_orders_plain", "order_id:i user_id:i total_amount:d order_status:s bucket:s item_count:i", """
    select o.order_id, o.user_id, o.total_amount, o.order_status,
        case o.order_status when 'Pending' then 'processed' else o.order_status end bucket,
        coalesce(sum(i.product_qty), 0) item_count
    from v_orders o left join v_order_items i on o.order_id = i.order_id
    where o.order_status <> 'out_for_delivery' group by all""")
put("order_items_detail", "order_id:i line_no:i itmname:s price:d qty:i total:d unit:s", """
    select order_id, line_no, product_name itmname, product_rate price, product_qty qty, product_amount total,
        unitname unit from v_order_items join v_units on product_unit = unitid""")
HEADER = """
    select o.order_id, o.order_no, o.order_status, o.total_amount, o.handling_fee, o.delivery_fee,
        o.coupon_discount discount_amount, o.coupon_code, t."name" customer_name, t.phone customer_phone,
        o.address_delivery address, coalesce(g.method, 'COD') pay_method, g.item_total
    from (select i.order_id, p.method, sum(i.product_amount) item_total
          from v_order_items i left join v_payments p on p.order_id = i.order_id group by i.order_id, p.method) g
    join v_orders o on o.order_id = g.order_id
    join v_address_last t on t.user_id = o.user_id"""
HEADER_SHAPE = ("order_id:i order_no:s order_status:s total_amount:d handling_fee:d delivery_fee:d discount_amount:d"
                " coupon_code:s customer_name:s customer_phone:s address:s pay_method:s item_total:d")
put("order_header_detail", HEADER_SHAPE, HEADER)
put("order_header_partner", HEADER_SHAPE, f"select * from ({HEADER}) r where order_status = 'out_for_delivery'")
put("order_document", "order_id:i page_no:i order_no:s address:s name:s phone:s item_total:d handling_fee:d"
    " delivery_fee:d discount:d total_amount:d coupon_code:s pay_mode:s items:s", f"""
    select h.order_id, 0 page_no, h.order_no, h.address, h.customer_name "name", h.customer_phone phone, h.item_total,
        coalesce(h.handling_fee, 0) handling_fee, coalesce(h.delivery_fee, 0) delivery_fee,
        coalesce(h.discount_amount, 0) discount, h.total_amount, nullif(h.coupon_code, '') coupon_code,
        h.pay_method pay_mode, l.items
    from ({HEADER}) h left join (
        select order_id, string_agg(product_name || '/' || product_rate || '/' || product_qty || '/' || product_amount
            || '/' || unitname, '; ' order by "position") items
        from v_lines join v_units on product_unit = unitid group by 1) l using (order_id)""")
put("recent_orders", "order_id:i order_no:s total_amount:d order_status:s customer:s items:i", """
    select order_id, order_no, total_amount, order_status, customer, items from (
        select o.order_id, o.order_no, o.total_amount, o.order_status, u."name" customer, count(i.product_id) items,
            o.created_at
        from v_orders o left join v_order_items i on i.order_id = o.order_id
        left join v_addresses u on u.user_id = o.user_id group by all
        order by o.created_at desc, o.order_id desc, u."name" nulls first limit 5) r""")
put("user_order_history", "order_id:i order_no:s user_id:i total_amount:d method:s order_status:s tracked_at:t items:i", """
    select order_id, order_no, user_id, total_amount, pay.method, order_status, step.created_at tracked_at,
        coalesce(sum(line.product_qty), 0) items
    from v_tracking step join v_orders using (order_id) join v_payments pay using (order_id)
    left join v_order_items line using (order_id) group by all""")
put("order_item_count", "order_id:i item_count:i", """
    select o.order_id, coalesce(sum(i.product_qty), 0) item_count
    from v_orders o left join v_order_items i on i.order_id = o.order_id group by 1""")
put("delivery_order_detail", "order_id:i order_no:s name:s phone:s address:s method:s", """
    select o.order_id, o.order_no, a."name", a.phone, a.full_address address, min(p.method) "method"
    from v_orders o join v_address_last a on a.user_id = o.user_id join v_payments p on p.order_id = o.order_id
    group by all""")
put("user_delivery_detail", "user_id:i order_id:i name:s phone:s full_address:s", """
    select o.user_id, o.order_id, a."name", a.phone, a.full_address from (
        select *, row_number() over (partition by user_id order by created_at desc, order_id desc) k from v_orders) o
    join v_address_last a on a.user_id = o.user_id where o.k = 1""")
put("tracking_timeline", "order_id:i status:s created_at:t position:i", """
    select order_id, lower(status) status, created_at,
        row_number() over (partition by order_id order by created_at, id) "position" from v_tracking""")
put("reorder_items", "order_id:i added:i skipped:i", """
    select order_id, count(*) filter (where product_id % 10 <> 0) added, count(*) filter (where product_id % 10 = 0) skipped
    from v_order_items group by 1""")
put("split_by_existence", "half:s order_id:i qty:i", """
    select case when product_id % 10 <> 0 then 'added' else 'skipped' end half, order_id, sum(product_qty) qty
    from v_order_items group by 1, 2""")
SUMMARY = "count(o.order_id) total_orders, coalesce(sum(o.total_amount), 0) total_spent, max(o.created_at) last_order"
put("customer_order_summary", "user_id:i total_orders:i total_spent:d last_order:t",
    f"select o.user_id, {SUMMARY} from v_orders o group by 1")
CUSTOMERS = """
    select a.user_id id, a."name", a.phone, a.full_address, count(o.order_id) total_orders,
        coalesce(strftime(max(o.created_at), '%Y-%m-%d'), '—') last_order
    from v_address_last a left join v_orders o on o.user_id = a.user_id where a."name" ilike '{0}' group by all"""
CUSTOMERS_SHAPE = "id:i name:s phone:s full_address:s total_orders:i last_order:s"
put("customer_list", CUSTOMERS_SHAPE, CUSTOMERS.format("%i%"))
put("customer_page", CUSTOMERS_SHAPE, f"select * from ({CUSTOMERS.format('%%')}) r order by id desc limit 10 offset 10")
put("customer_page_after", CUSTOMERS_SHAPE,
    f"select * from ({CUSTOMERS.format('%%')}) r where id < 40 order by id desc limit 10")
put("customer_directory", "user_id:i name:s phone:s email:s added_by:s city:s total_orders:i total_spent:d"
    " last_order:t", f"""
    select u.user_id, case when u.added_by = 'app' and coalesce(a."name", '') <> '' then a."name" else u."name" end "name",
        u.phone, u.email, u.added_by, case when u.added_by = 'app' then a.city end city, {SUMMARY}
    from v_users u left join v_address_newest a on a.user_id = u.user_id left join v_orders o on o.user_id = u.user_id
    group by all""")
put("customer_details", "user_id:i total_orders:i total_spent:d last_order:t address_name:s address_city:s", f"""
    select u.user_id, {SUMMARY}, a."name" address_name, a.city address_city
    from v_users u left join v_address_newest a on a.user_id = u.user_id left join v_orders o on o.user_id = u.user_id
    group by u.user_id, a."name", a.city""")
put("latest_address_per_user", "user_id:i address_id:i name:s city:s",
    "select user_id, address_id, \"name\", city from v_address_last")
put("newest_address_by_time", "user_id:i address_id:i name:s city:s",
    "select user_id, address_id, \"name\", city from v_address_newest")
put("address_book", "user_id:i address_id:i name:s is_default:b created_at:t position:i", """
    select user_id, address_id, "name", is_default, created_at, row_number() over (partition by user_id
        order by is_default desc nulls first, created_at desc nulls first, address_id desc) "position"
    from v_addresses""")
put("review_status", "user_id:i is_reviewed:b",
    "select user_id, user_id in (select user_id from v_reviews) is_reviewed from v_users")
put("tag_counts", "tag:s reviews:i", """
    select tag, n reviews from (select 'fresh' tag, count(*) filter (where fresh) n from v_reviews
    union all select 'rude', count(*) filter (where rude) from v_reviews
    union all select 'late', count(*) filter (where late) from v_reviews) r where n > 0""")
put("first_order_discount", "user_id:i discount:i", """
    select user_id, case when exists (select 1 from v_orders o where o.user_id = u.user_id) then 0 else 100 end discount
    from (select user_id from v_users union all select user_id + 10000000 from v_users) u""")
put("driver_list", "driver_id:i full_name:s mobile:s status:i created_at:D",
    "select driver_id, full_name, mobile, status, created_at from v_partners")
put("row_totals", "listing:s total:i", """
    select 'orders' listing, count(*) total from orders union all select 'customers', count(*) from customer
    union all select 'items', count(*) from part union all select 'purchases', count(*) from supplier""")

# --- purchases and invoices

PURCHASES = """
    select p.purchaseid, strftime(p.purchasedate, '%d-%m-%Y') "date", p.purchase_no, coalesce(p.refrence, '') refrence,
        case p.cansts when 1 then 'Cancelled' else 'Active' end status,
        (select sum(l."value") from v_ledger l where l.purchase_id = p.purchaseid
            and (l.itmcandel is null or l.itmcandel = 0) and (l.canordersts is null or l.canordersts = 0)) totamt
    from v_purchases p {0}"""
PURCHASES_SHAPE = "purchaseid:i date:s purchase_no:s refrence:s status:s totamt:d"
put("purchase_list", PURCHASES_SHAPE, PURCHASES.format(""))
put("purchase_page", PURCHASES_SHAPE, "select * from (" + PURCHASES.format(
    "where (p.purchase_no ilike '%ref-%' or p.refrence ilike '%ref-%') and p.purchasedate >= date '1997-01-05'") + ") r order by purchaseid desc limit 15")
put("purchase_document", "purchase_id:i page_no:i purchase_no:s purchase_date:D reference:s items:s", """
    select p.purchaseid purchase_id, coalesce(l.page_no, 0) page_no, p.purchase_no, p.purchasedate purchase_date,
        coalesce(p.refrence, '') reference, l.items
    from v_purchases p left join (
        select purchase_id, (k - 1) // 100 page_no, string_agg(itmid || '/' || unitname || '/' || stockqty || '/'
            || "value", '; ' order by k) items
        from (select *, row_number() over (partition by purchase_id order by orderid, line_no, itmid, stockqty, "value") k
              from v_ledger join v_units using (unitid) where itmcandel = 0) r group by 1, 2) l
    on l.purchase_id = p.purchaseid""")
INVOICE = """
    select o.order_id, o.order_no, o.total_amount, o.created_at, coalesce(a."name", 'N/A') customer_name,
        coalesce(a.phone, 'N/A') phone, coalesce(a.full_address, 'N/A') full_address
    from v_orders o left join v_address_last a on a.user_id = o.user_id"""
INVOICE_SHAPE = "order_id:i order_no:s total_amount:d created_at:t customer_name:s phone:s full_address:s"
put("invoice_header", INVOICE_SHAPE, INVOICE)
put("invoice_document", INVOICE_SHAPE + " page_no:i items:s", f"""
    select h.*, coalesce(l.page_no, 0) page_no, l.items from ({INVOICE}) h left join (
        select order_id, ("position" - 1) // 4 page_no, string_agg("position" || '/' || product_name || '/'
            || product_qty || '/' || product_amount, '; ' order by "position") items
        from v_lines group by 1, 2) l using (order_id)""")
put("invoice_text", "order_id:i page_no:i kind:s items_text:s link:s total_text:s", f"""
    select h.order_id, 0 page_no, case when full_address = 'N/A' then 'pickup' else 'delivery' end kind, l.items_text,
        case when full_address = 'N/A' then 'https://orders.example.com/order/' || h.order_no
        else 'https://www.google.com/maps/search/?api=1&query=' || url_encode(full_address) end link,
        'Total Amount: ₹' || h.total_amount total_text
    from ({INVOICE}) h left join (
        select order_id, string_agg("position" || '. ' || product_name || '  x' || product_qty || '  ₹'
            || product_amount, chr(10) order by "position") items_text from v_lines group by 1) l using (order_id)""")

# --- catalogue

CATALOGUE = """
    select p.product_id id, p.title "name", c.categories_name category, p.categories_id, p.price, p.mrp, p.description,
        p.itmsts, p.unit, case when p.itmsts = 1 then 'Active' else 'In-Active' end status, p.lowstqty, p.openbalqty,
        p.openbaldate, p.discount_per, p.discount_sts, p.itm_spctyp itmtype, m.image_url image
    from v_products p join v_categories c on c.categories_id = p.categories_id
    left join v_item_image m on m.product_id = p.product_id"""
CATALOGUE_SHAPE = ("id:i name:s category:s categories_id:i price:d mrp:d description:s itmsts:i unit:i status:s"
                   " lowstqty:i openbalqty:i openbaldate:D discount_per:d discount_sts:i itmtype:s image:s")
put("catalogue_list", CATALOGUE_SHAPE, CATALOGUE)
put("catalogue_page", CATALOGUE_SHAPE,
    f"select * from ({CATALOGUE}) r where \"name\" ilike '%widget%' order by id limit 15 offset 15")
put("catalogue_page_after", CATALOGUE_SHAPE,
    f"select * from ({CATALOGUE}) r where \"name\" ilike '%widget%' and id > 60 order by id limit 15")
put("category_items", "product_id:i categories_id:i title:s price:d mrp:d description:s unit:s current_stock:i"
    " image:s", """
    select p.product_id, p.categories_id, p.title, p.price, p.mrp, p.description, u.unitname unit,
        s.stock current_stock, m.image_url image
    from v_products p join v_units u on p.unit = u.unitid join v_stock s on s.product_id = p.product_id
    left join v_item_image m on m.product_id = p.product_id""")
put("search_items", "id:i name:s category:s categories_id:i price:d mrp:d stock:i image:s", """
    select p.product_id id, p.title "name", c.categories_name category, p.categories_id, p.price, p.mrp,
        case when p.openbalqty is not null then s.stock end stock, coalesce(m.image_url, '') image
    from v_products p join v_categories c on c.categories_id = p.categories_id
    join v_stock s on s.product_id = p.product_id left join v_item_image m on m.product_id = p.product_id
    where p.title ilike '%ring%'""")
put("popular_tags", "categories_name:s", "select categories_name from v_categories order by categories_id limit 10")
put("global_search", "id:i name:s url:s nav:s", """
    (select product_id id, title || '--(Item)' "name", 'search' url, 'item' nav from v_products
     where title ilike '%m%' order by product_id limit 30)
    union all
    (select categories_id, categories_name || '--(Category)', 'category', 'category' from v_categories
     where categories_name ilike '%m%' order by categories_id limit 30)""")
put("item_prices", "id:i name:s price:d", "select product_id id, title \"name\", price from v_products")
OFFER = "round(price * (100 - discount_per) * cast(0.01 as decimal(3,2)), 2)"
put("super_deals", "id:i name:s original:d discount:d offer:d", f"""
    select product_id id, title "name", price original, discount_per discount, {OFFER} offer
    from v_products where discount_sts = 1 and discount_per > 0""")
DEAL = f"""
    select p.product_id, p.title "name", p.discount_per discount,
        case when p.discount_sts = 1 then {OFFER} else p.price end price, p.price "oldPrice", m.image_url img,
        u.unitname weight, s.stock current_stock, p.discount_sts, p.discount_per, p.itm_spctyp, p.categories_id
    from v_products p join v_units u on u.unitid = p.unit join v_stock s on s.product_id = p.product_id
    left join v_item_image m on m.product_id = p.product_id"""
HOME_SHAPE = "product_id:i name:s discount:d price:d oldPrice:d img:s weight:s current_stock:i"
put("deal_price", HOME_SHAPE + " discount_per:d discount_sts:i itm_spctyp:s", DEAL)
put("ordered_categories", "categories_id:i last_order_id:i", """
    select categories_id, max(order_id) last_order_id from v_order_items join v_products using (product_id) group by 1""")
RECO = f"""select * from ({DEAL}) r where categories_id in (select distinct categories_id
    from v_order_items join v_products using (product_id) order by 1 limit 500) order by product_id limit 12"""
put("recommendations", HOME_SHAPE, RECO)
put("home_feed", "section:s " + HOME_SHAPE, f"""
    select 'deals' section, * from ({DEAL}) a where discount_sts = 1 and discount_per > 0
    union all select 'veg', * from ({DEAL}) b where itm_spctyp = 'vegitable'
    union all select 'fruit', * from ({DEAL}) c where itm_spctyp = 'fruit'
    union all select 'reco', * from ({RECO}) d""")
put("favourites_list", "user_id:i fav_id:i product_id:i title:s price:d unit:i thumbnail:s", """
    select user_id, fav_id, product_id, title, price, unit, thumbnail
    from v_favourites join v_products using (product_id)""")
put("cart_list", "cart_id:i user_id:i product_id:i quantity:i product_name:s thumbnail:s price:d created_at:t", """
    select cart_id, user_id, c.product_id, quantity, title product_name, thumbnail, price, created_at
    from v_cart c left join v_products p on p.product_id = c.product_id where status = 'active'""")
put("flash_sale_items", "register_id:i flsh_trnid:i product_id:i title:s product_rate:d from_datetime:t to_datetime:t", """
    select register_id, flsh_trnid, product_id, title, product_rate, from_datetime, to_datetime
    from v_flash_sales join v_flash_sale_lines using (flsh_trnid) join v_products using (product_id)
    where timestamp '1998-02-01' between from_datetime and to_datetime""")
put("flash_sale_orders", "flsh_trnid:i product_id:i sold_qty:i", """
    select flsh_trnid, product_id, sum(product_qty) sold_qty
    from v_orders join v_order_items using (order_id) join v_flash_sale_lines using (product_id)
    join v_flash_sales using (flsh_trnid)
    where v_orders.created_at + to_hours(cast(order_id % 24 as int)) + to_minutes(cast(order_id % 60 as int))
        between from_datetime + to_hours(cast(flsh_trnid % 24 as int)) + to_minutes(cast(flsh_trnid % 60 as int))
        and to_datetime + to_hours(cast(flsh_trnid * 7 % 24 as int)) + to_minutes(cast(flsh_trnid * 7 % 60 as int))
    group by 1, 2""")
put("dedupe_any", "product_id:i title:s image:s",
    "select product_id, title, image_url image from v_products join v_item_image using (product_id)")
put("missing_dimension_members", "kind:s member:s", """
    select distinct 'category' kind, trim(categoriesname) "member" from v_item_sheet s where not exists (
        select 1 from v_categories c where trim(c.categories_name) = trim(s.categoriesname))
    union all select distinct 'unit', trim(unit) from v_item_sheet s where not exists (
        select 1 from v_units u where trim(u.unitshortcode) = trim(s.unit))
    union all select distinct 'title', trim(title) from v_item_sheet s where not exists (
        select 1 from v_products p where trim(p.title) = trim(s.title))""")
put("distinct_members", "member:s", "select distinct trim(categoriesname) \"member\" from v_item_sheet")

# --- prices

CARTS = "select order_id cart_id, user_id, 'save' || (order_id % 95) coupon_code, total_amount cart_total from v_orders"
GUEST_CARTS = CARTS.replace("user_id,", "case when order_id % 4 = 0 then user_id + 10000000 else user_id end user_id,", 1)


def applied(carts: str) -> str:
    return f"""
    select c.cart_id, c.user_id, c.cart_total, case
        when k.coupon_id is null then 'invalid'
        when c.cart_total < k.min_order_value then 'below_minimum'
        when exists (select 1 from v_coupon_usage u where u.coupon_id = k.coupon_id and u.user_id = c.user_id) then 'used'
        end reason, k.coupon_id,
        case when k.discount_type = 'FLAT' then k.discount_value
            when k.max_discount is not null and c.cart_total * k.discount_value > k.max_discount * 100 then k.max_discount
            else c.cart_total * k.discount_value * cast(0.01 as decimal(3,2)) end discount
    from ({carts}) c left join v_coupons k on k.coupon_code = upper(c.coupon_code) and k.is_active
        and (k.expiry_date is null or k.expiry_date >= date '2000-06-01')"""


put("apply_coupon", "cart_id:i user_id:i cart_total:d reason:s coupon_id:i discount:d", f"""
    select cart_id, user_id, cart_total, reason, case when reason is null then coupon_id end coupon_id,
        case when reason is null then discount end discount from ({applied(CARTS)}) a""")
put("checkout_price", "cart_id:i coupon_id:i cart_total:d first_order_discount:d coupon_discount:d to_pay:d", f"""
    select cart_id, coupon_id, cart_total, w first_order_discount, least(discount, cart_total - w) coupon_discount,
        greatest(cart_total - w - least(discount, cart_total - w), 0) to_pay
    from (select *, least(case when exists (select 1 from v_orders o where o.user_id = a.user_id)
            then 0 else 100 end, cart_total) w from ({applied(GUEST_CARTS)}) a
          where reason is null) r""")
put("coupon_list_with_usage", "coupon_id:i coupon_code:s discount_type:s discount_value:d min_order_value:d"
    " max_discount:d expiry_date:D is_active:b is_used:b", """
    select c.*, exists (select 1 from v_coupon_usage u where u.coupon_id = c.coupon_id and u.user_id = 20) is_used
    from v_coupons c where is_active""")
put("coupon_uses", "user_id:i coupon_id:i coupon_code:s order_id:i is_used:b", """
    select user_id, coupon_id, coupon_code, order_id, true is_used
    from v_coupon_usage join v_coupons using (coupon_id) where is_active""")
put("cart_bill", "user_id:i item_total:d handling_fee:i delivery_fee:i to_pay:d", """
    select u.user_id, coalesce(sum(p.price * c.quantity), 0) item_total,
        case when count(c.cart_id) > 0 then 5 else 0 end handling_fee,
        case when count(c.cart_id) > 0 then 25 else 0 end delivery_fee,
        coalesce(sum(p.price * c.quantity), 0) + case when count(c.cart_id) > 0 then 30 else 0 end to_pay
    from v_users u left join v_cart c on c.user_id = u.user_id and c.status = 'active'
    left join v_products p on p.product_id = c.product_id group by 1""")
CLOCK = "ltrim(lower(strftime({0}, '%I:%M %p')), '0')"
put("delivery_slots", "request_id:i day:s slot_start:t slot_end:t label:s", f"""
    select request_id, "day", s slot_start, s + interval 1 hour slot_end,
        "day" || ', ' || {CLOCK.format('s')} || ' - ' || {CLOCK.format('s + interval 1 hour')} label
    from (
        select event_id request_id, 'Today' "day", date_trunc('day', ts) + to_minutes(cast(m as int)) s, ts
        from events, (select unnest(range(0, 1440, 30)) m) g
        where m + 60 <= 1230
          and m >= extract(hour from ts) * 60 + case when extract(minute from ts) <= 30 then 30 else 60 end
          and m % 60 = case when extract(minute from ts) <= 30 then 30 else 0 end
        union all
        select event_id, 'Tomorrow', date_trunc('day', ts) + interval 1 day + to_hours(cast(h as int)), ts
        from events, (select unnest(range(10, 20)) h) g) r""")
INNER = bytes(b ^ 0x36 for b in b"test-secret".ljust(64, b"\0")).hex()
OUTER = bytes(b ^ 0x5C for b in b"test-secret".ljust(64, b"\0")).hex()
put("payment_signature_audit", "order_id:i expected:s is_valid:b", f"""
    select order_id, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(
        'order_' || order_id || '|pay_' || method || lpad(cast(order_id as varchar), 8, '0'))))) expected,
        order_id % 3 = 1 is_valid from v_payments""")


def otp(valid: str) -> str:
    return f"""
    select user_id, seq, "at", issue_seq, case when issue_seq is null then 'no_code' when code is null or issue_code is null or code <> issue_code then 'wrong_code'
        when not in_time then 'expired'
        when row_number() over (partition by issue_seq, coalesce(code = issue_code, false), in_time order by "at", seq) = 1 then 'matched'
        else 'used' end outcome
    from (select a.*, i.seq issue_seq, i.code issue_code, {valid} in_time
        from (select case when event_id % 40 <> 0 then user_id end user_id, event_id seq, ts "at",
                nullif(cast(floor("value") as bigint) % 4, 3) code from events
              where event_type = 'purchase') a
        left join (select case when event_id % 40 <> 0 then user_id end user_id, event_id seq, ts "at",
                nullif(cast(floor("value") as bigint) % 4, 3) code,
                   lead(ts) over (partition by case when event_id % 40 <> 0 then user_id end order by ts, event_id) until_at from events
                   where event_type = 'signup') i
        on i.user_id = a.user_id and i."at" <= a."at" and (i.until_at is null or i.until_at > a."at")) r"""


OTP_SHAPE = "user_id:i seq:i at:t issue_seq:i outcome:s"
put("otp_match", OTP_SHAPE, otp('i."at" + interval 2 day > a."at"'))
put("otp_match_delivery", OTP_SHAPE, otp("true"))
put("address_components", "document_id:i street:s area:s city:s pincode:s", """
    select address_id document_id, street, case
        when address_id % 5 = 0 then 'Block ' || address_id when address_id % 3 = 0 then 'Ward ' || address_id
        when locality <> '' then locality else street end area,
        case when locality <> '' then locality when address_id % 4 <> 0 then "name" else '' end city,
        case when address_id % 6 <> 0 then phone else '' end pincode
    from (select *, case when address_id % 2 = 0 then 'Road ' || address_id else '' end street,
        case when address_id % 7 <> 0 then coalesce(city, '') else '' end locality from v_addresses) r""")

# --- one store's tables

OWN_USERS = "user_id in (select user_id from v_users where register_id = 7)"
put("tenant_scan_orders", "order_id:i user_id:i", f"select order_id, user_id from v_orders where {OWN_USERS}")
put("tenant_scan_ledger", "itmid:i rows:i qty:i", """
    select itmid, count(*) "rows", sum(stockqty) qty from v_ledger
    where purchase_id in (select purchaseid from v_purchases where storeid = 7) group by 1""")
put("tenant_stock_ledger", "product_id:i title:s lowstqty:i itmsts:i openbalqty:i stock:i", """
    select p.product_id, p.title, p.lowstqty, p.itmsts, p.openbalqty, coalesce(p.openbalqty, 0) + coalesce((
        select sum(case when s.instoreid > 0 then s.stockqty when s.outstoreid > 0 then -s.stockqty else 0 end)
        from v_ledger s where s.itmid = p.product_id and coalesce(s.itmcandel, 0) = 0 and coalesce(s.canordersts, 0) = 0
        and s.purchase_id in (select purchaseid from v_purchases where storeid = 7)
        and s.purchase_date >= coalesce(p.openbaldate, date '1995-01-01')), 0) stock from v_products p""")
SQL["stored_stock_ledger"] = SQL["tenant_stock_ledger"]
SQL["stock_ledger_snapshot"] = SQL["stock_ledger"]
put("tenant_admin_order_list", ADMIN_SHAPE, ADMIN.replace("from v_orders r", f"from (select * from v_orders where {OWN_USERS}) r"))
put("tenant_customer_list", CUSTOMERS_SHAPE, CUSTOMERS.format("%%").replace(
    "where a.", "where a.user_id in (select user_id from v_users where register_id = 7) and a."))
put("tenant_cart_bill", "user_id:i item_total:d handling_fee:i delivery_fee:i to_pay:d", """
    select u.user_id, coalesce(sum(p.price * c.quantity), 0) item_total, 5 * least(count(c.cart_id), 1) handling_fee,
        25 * least(count(c.cart_id), 1) delivery_fee,
        coalesce(sum(p.price * c.quantity), 0) + 30 * least(count(c.cart_id), 1) to_pay
    from (select * from v_users where register_id = 7) u
    left join v_cart c on c.user_id = u.user_id and c.status = 'active'
    left join v_products p on p.product_id = c.product_id group by 1""")
