"""The logical tables as SQL views over the supplied tables, for the independent answers."""

VIEWS = {
    "tenants": "select n_nationkey register_id, n_name store_name, n_regionkey region_id from nation",
    "users": """select c_custkey user_id, c_name name, '9' || lpad(cast(c_custkey as varchar), 9, '0') phone,
        lower(c_mktsegment) || c_custkey || '@example.com' email,
        case when c_custkey % 2 = 0 then 'app' else 'admin' end added_by, 'user' user_role,
        c_nationkey register_id from customer""",
    "addresses": """select event_id address_id, user_id, event_type name,
        '8' || lpad(cast(event_id % 100000 as varchar), 9, '0') phone,
        case when value >= 5 then cast(cast(floor(value) as int) as varchar) end city,
        case when event_id % 6 <> 0 then 'No ' || event_id || ', ' || event_type end full_address,
        ts created_at, event_id % 11 = 0 is_default from events""",
    "categories": """select distinct ascii(p_type) * 100 + length(p_type) categories_id, p_type categories_name,
        1 cat_sts from part""",
    "products": """select p_partkey product_id, p_name title, p_type category,
        ascii(p_type) * 100 + length(p_type) categories_id, p_brand || ' ' || p_name description,
        cast(p_size % 6 as int) unit, cast(p_retailprice as decimal(10,2)) price,
        cast(cast(p_retailprice as decimal(10,2)) + p_size % 5 * 10 as decimal(10,2)) mrp,
        cast((p_size % 4) * 5 as decimal(5,2)) discount_per, p_size % 2 discount_sts, p_size * 10 lowstqty,
        case when p_partkey % 7 <> 0 then p_size * 2 end openbalqty,
        case p_partkey % 3 when 1 then date '1997-01-01' when 2 then date '1999-01-01' end openbaldate,
        case when p_partkey % 10 = 0 then 0 else 1 end itmsts,
        case p_size % 3 when 0 then 'vegitable' when 1 then 'fruit' end itm_spctyp,
        'thumb/' || p_partkey || '.png' thumbnail from part""",
    "units": "select r_regionkey unitid, substr(r_name, 1, 4) unitshortcode, r_name unitname from region",
    "images": """select p_partkey product_id, 'img/' || p_partkey || '-' || k || '.png' image_url
        from part, (values (1), (2)) c(k) where k <= p_size % 3""",
    "orders": """select o_orderkey order_id, 'ORD' || lpad(cast(o_orderkey as varchar), 10, '0') order_no,
        o_custkey user_id, cast(o_totalprice as decimal(12,2)) total_amount,
        cast(case when o_orderkey % 3 = 0 then 20 else 0 end as decimal(10,2)) handling_fee,
        cast(case when o_orderkey % 4 <> 0 then 40 end as decimal(10,2)) delivery_fee,
        cast(case when o_orderkey % 10 = 0 then 75 end as decimal(10,2)) coupon_discount,
        case when o_orderkey % 10 = 0 then 'SAVE' || (o_orderkey % 90) when o_orderkey % 10 = 1 then '' end coupon_code,
        case when o_orderpriority = '5-LOW' then 'cancelled' when o_orderstatus = 'F' then 'delivered'
             when o_orderstatus = 'P' then 'out_for_delivery' else 'Pending' end order_status,
        case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'complete' else 'pending' end payment_status,
        cast(o_orderkey % 5 as int) delivery_id, 'Lane ' || o_custkey address_delivery, o_orderdate created_at,
        o_orderdate + interval 10 hour delivery_start, o_orderdate + interval 11 hour delivery_end from orders""",
    "order_items": """select l_orderkey order_id, l_partkey product_id, l_linenumber line_no,
        'Item ' || l_partkey product_name, cast(l_partkey % 6 as int) product_unit,
        cast(l_quantity as int) product_qty,
        cast(floor(l_extendedprice / l_quantity) as decimal(12,2)) product_rate,
        cast(l_extendedprice as decimal(12,2)) product_amount, l_suppkey supplier_id from lineitem""",
    "payments": """select o_orderkey order_id,
        case o_orderkey % 3 when 0 then 'COD' when 1 then 'UPI' else 'Card' end method,
        case when o_orderkey % 3 = 0 then 'PENDING' else 'complete' end status, o_orderdate created_at
        from orders where o_orderkey % 4 <> 0""",
    "tracking": "select event_id id, user_id order_id, upper(event_type) status, ts created_at from events",
    "cart": """select event_id cart_id, user_id, event_id % 3000 product_id, cast(floor(value) as int) + 1 quantity,
        case when event_type = 'error' then 'removed' else 'active' end status, ts created_at from events""",
    "favourites": """select user_id, event_id % 3000 product_id, min(event_id) fav_id from events
        where event_type = 'purchase' group by 1, 2""",
    "delivery_modes": """select * from (values (1, 'Cash on Delivery'), (2, 'Online Payment'), (3, 'Card / Swipe'),
        (4, 'UPI Payment')) m(delivery_id, delivery_mode)""",
    "coupons": """select s_suppkey coupon_id, 'SAVE' || s_suppkey coupon_code,
        case when s_suppkey % 2 = 0 then 'PERCENT' else 'FLAT' end discount_type,
        cast(s_suppkey % 40 + 5 as decimal(10,2)) discount_value,
        cast(s_suppkey % 5 * 50000 as decimal(10,2)) min_order_value,
        cast(case when s_suppkey % 3 <> 0 then (s_suppkey % 7 + 1) * 1000 end as decimal(10,2)) max_discount,
        case when s_suppkey % 4 <> 0 then date '1999-01-01' + cast(s_suppkey % 1500 as int) end expiry_date,
        s_suppkey % 10 <> 3 is_active from supplier""",
    "coupon_usage": """select o_orderkey % 90 coupon_id, o_custkey user_id, min(o_orderkey) order_id
        from orders where o_orderkey % 10 = 0 group by 1, 2""",
    "partners": """select s_suppkey driver_id, s_name full_name,
        '7' || lpad(cast(s_suppkey as varchar), 9, '0') mobile,
        case when s_suppkey % 9 = 0 then 0 else 1 end status, s_nationkey register_id,
        case when s_suppkey % 8 <> 0 then date '2000-01-01' + cast(s_suppkey % 365 as int) end created_at from supplier""",
    "reviews": """select doc_id user_id, 1 + quality * 3 + toxic rating, quality = 1 fresh, toxic = 1 rude,
        doc_id % 3 = 0 late from labels""",
    "ledger": """select l_suppkey purchase_id, l_orderkey orderid, l_partkey itmid, l_linenumber line_no,
        cast(l_shipdate as date) purchase_date,
        case when l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'F') then 1 else 0 end instoreid,
        case when l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'F') then 0 else 2 end outstoreid,
        cast(l_partkey % 6 as int) unitid, cast(l_quantity as int) stockqty,
        cast(l_extendedprice as decimal(12,2)) "value",
        case when l_linenumber = 7 then 1 when l_linenumber <> 6 then 0 end itmcandel,
        case when l_discount >= 0.09 then 1 else 0 end canordersts from lineitem""",
    "purchases": """select s_suppkey purchaseid, s_name purchase_no,
        case when s_suppkey % 4 <> 0 then 'REF-' || s_suppkey end refrence,
        date '1997-01-01' + cast(s_suppkey % 700 as int) purchasedate,
        case when s_suppkey % 9 = 0 then 1 else 0 end cansts, s_nationkey storeid from supplier""",
    "flash_sales": """select s_suppkey flsh_trnid, s_nationkey register_id,
        cast(date '1998-01-01' + cast(s_suppkey % 1000 as int) as timestamp) from_datetime,
        cast(date '1998-01-01' + cast(s_suppkey % 1000 as int) as timestamp) + interval 400 day to_datetime
        from supplier""",
    "flash_sale_lines": """select p_partkey % 113 flsh_trnid, p_partkey product_id,
        cast(cast(p_retailprice as decimal(10,2)) - p_size % 9 as decimal(10,2)) product_rate from part""",
    "item_sheet": """select p_partkey trnid,
        case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then '  ' || p_name || ' ' || p_brand || ' '
             when p_partkey % 12 <> 6 then p_name || ' ' || p_brand end title,
        case when p_size % 7 = 0 then ' ' || p_type || ' ' when p_size % 11 = 0 then 'NEW ' || p_brand
             when p_size % 13 <> 0 then p_type end categoriesname,
        case when p_partkey % 5 <> 0 then p_brand end description,
        case when p_partkey % 6 <> 0 then cast(p_retailprice as decimal(10,2)) end price,
        case when p_partkey % 8 <> 0 then cast(p_retailprice as decimal(10,2)) end mrp,
        case when p_partkey % 9 <> 0 then p_size end quantity,
        case p_size % 6 when 0 then 'AFRI ' when 1 then 'ASIA' when 3 then 'BOX' when 4 then 'EURO'
             when 5 then 'CRATE ' end unit from part""",
    "address_last": """select * from (select *, row_number() over (partition by user_id order by address_id desc) rn
        from v_addresses) where rn = 1""",
    "address_newest": """select * from (select *, row_number() over (partition by user_id
        order by created_at desc nulls first, address_id desc) rn from v_addresses) where rn = 1""",
    "item_image": "select product_id, min(image_url) image_url from v_images group by 1",
    "stock": """select p.product_id, p.title, p.lowstqty, p.itmsts, p.openbalqty, coalesce(p.openbalqty, 0) + coalesce((
        select sum(case when s.instoreid > 0 then s.stockqty when s.outstoreid > 0 then -s.stockqty else 0 end)
        from v_ledger s where s.itmid = p.product_id and coalesce(s.itmcandel, 0) = 0
        and coalesce(s.canordersts, 0) = 0
        and s.purchase_date >= coalesce(p.openbaldate, date '1995-01-01')), 0) stock from v_products p""",
    "lines": """select *, row_number() over (partition by order_id
        order by line_no, product_id, product_qty, product_amount) "position" from v_order_items""",
}

# Views that read other views.
NEEDS = {
    "address_last": ["addresses"], "address_newest": ["addresses"], "item_image": ["images"],
    "stock": ["ledger", "products"], "lines": ["order_items"],
}

# Output types, so that both engines hand over the same plain values.
SHAPES = {
    "i": 'cast("{0}" as bigint) "{0}"',
    "d": 'cast("{0}" as double) "{0}"',
    "s": 'cast("{0}" as varchar) "{0}"',
    "b": 'cast("{0}" as boolean) "{0}"',
    "D": """strftime("{0}", '%Y-%m-%d') "{0}\"""",
    "t": """strftime("{0}", '%Y-%m-%d %H:%M:%S.%f') "{0}\"""",
}


def answer(shape: str, body: str) -> str:
    """SQL of an answer: the views it names as ``v_…``, and its columns in plain types.

    ``shape`` lists the output columns as ``name:type``.
    """
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if any(word == f"v_{name}" for word in _words(body)):
            add(name)
    views = ",\n".join(f"v_{name} as ({VIEWS[name]})" for name in wanted)
    columns = ", ".join(SHAPES[kind].format(name) for name, kind in (c.split(":") for c in shape.split()))
    return f"with {views + ', ' if views else ''}body as ({body})\nselect {columns} from body"


def _words(text: str) -> list[str]:
    return "".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split()
