"""Independent SQL answers to loading, change and stream queries."""

from oracle.views import answer

SQL: dict[str, str] = {}


def put(name: str, shape: str, body: str) -> None:
    SQL[name] = answer(shape, body)


# --- loading

CLEAN = """select trnid, coalesce(title, '') title, coalesce(categoriesname, '') categoriesname,
    coalesce(description, '') description, coalesce(price, 0) price, coalesce(mrp, 0) mrp,
    coalesce(quantity, 0) quantity, coalesce(unit, '') unit from v_item_sheet"""
put("bulk_item_scan", "title:s categoriesname:s description:s price:d mrp:d quantity:i unit:s", CLEAN)
NEW_CATEGORIES = f"""
    select (select max(categories_id) from v_categories) + row_number() over (order by md5(m)) categories_id,
        m categories_name, 1 cat_sts
    from (select distinct trim(categoriesname) m from ({CLEAN}) s) r
    where m not in (select trim(categories_name) from v_categories)"""
NEW_UNITS = f"""
    select (select max(unitid) from v_units) + row_number() over (order by md5(m)) unitid, m unitshortcode, m unitname,
        1 isbaseunit, 0 baseunitid, 100 decimalbasefactor
    from (select distinct trim(unit) m from ({CLEAN}) s) r where m not in (select trim(unitshortcode) from v_units)"""
put("bulk_item_load_categories", "categories_id:i categories_name:s cat_sts:i", NEW_CATEGORIES)
put("bulk_item_load_units", "unitid:i unitshortcode:s unitname:s isbaseunit:i baseunitid:i decimalbasefactor:i",
    NEW_UNITS)
put("bulk_item_load_products", "product_id:i trnid:i categories_id:i title:s description:s price:d mrp:d quantity:i"
    " unit:i", f"""
    select (select max(product_id) from v_products) + row_number() over (order by trnid) product_id, trnid,
        c.categories_id, title, description, price, mrp, quantity, u.unitid unit
    from ({CLEAN}) s
    join (select categories_id, categories_name from v_categories union all
          select categories_id, categories_name from ({NEW_CATEGORIES}) n) c
        on trim(c.categories_name) = trim(s.categoriesname)
    join (select unitid, unitshortcode from v_units union all select unitid, unitshortcode from ({NEW_UNITS}) n) u
        on trim(u.unitshortcode) = trim(s.unit)
    where trim(title) not in (select trim(title) from v_products)""")
DOCS = """
    select *, row_number() over (order by p_partkey) k from part
    where p_partkey % 6 <> 0 and p_partkey % 7 <> 0 and p_size % 5 <> 0"""
put("category_product_load_categories", "categories_id:i categories_name:s", f"""
    select (select max(categories_id) from v_categories) + k categories_id, p_brand categories_name from ({DOCS}) d""")
put("category_product_load_products", "product_id:i categories_id:i title:s description:s price:d mrp:d quantity:i"
    " thumbnail:s", f"""
    select (select max(product_id) from v_products) + k product_id,
        (select max(categories_id) from v_categories) + k categories_id,
        case when p_partkey % 11 = 0 then '0' else p_name end title, p_type description,
        p_retailprice price, p_retailprice mrp, p_size % 5 quantity, 't.png' thumbnail from ({DOCS}) d""")
put("category_product_load_images", "product_id:i image_url:s", f"""
    select (select max(product_id) from v_products) + k product_id, 'doc/' || p_partkey || '-' || n || '.png' image_url
    from ({DOCS}) d, (values (1), (2)) c(n) where p_size % 2 = 0""")
put("nested_order_scan", "order_id:i user_id:i total_amount:d item_no:i product_id:i product_qty:i product_amount:d", """
    select o.order_id, o.user_id, o.total_amount, l."position" - 1 item_no, l.product_id, l.product_qty, l.product_amount
    from v_orders o left join v_lines l on l.order_id = o.order_id""")
put("order_fanout_orders", "order_id:i user_id:i address_delivery:s total_amount:d order_status:s payment_status:s"
    " delivery_id:i delivery_start:s coupon_code:s", """
    select order_id, user_id, address_delivery, total_amount, order_status, payment_status, delivery_id,
        strftime(delivery_start, '%Y-%m-%d %H:%M:%S') delivery_start, coupon_code from v_orders""")
put("order_fanout_order_items", "order_id:i product_id:i product_name:s product_unit:i product_qty:i product_rate:d"
    " product_amount:d discount_amt:d discount_per:d", """
    select order_id, product_id, product_name, product_unit, product_qty, product_rate, product_amount,
        0 discount_amt, 0 discount_per from v_order_items""")
put("order_fanout_ledger", "purchase_id:i purchase_date:D orderid:i instoreid:i outstoreid:i itmid:i itmname:s"
    " unitid:i stockqty:i rate:d value:d currentstock:i itmcandel:i canordersts:i", """
    select 0 purchase_id, date '2001-08-01' purchase_date, order_id orderid, 0 instoreid, 2 outstoreid,
        product_id itmid, product_name itmname, product_unit unitid, product_qty stockqty, product_rate rate,
        product_amount "value", product_qty currentstock, 0 itmcandel, 0 canordersts from v_order_items""")
put("order_fanout_payments", "order_id:i method:s status:s transaction_id:s", """
    select order_id, case when order_id % 3 = 0 then 'COD' else 'UPI' end "method",
        case when order_id % 3 = 0 then 'PENDING' else 'complete' end status,
        case when order_id % 3 <> 0 then 'tx' || order_id end transaction_id from v_orders""")
put("order_fanout_tracking", "order_id:i status:s message:s",
    "select order_id, 'pending' status, 'Order placed successfully' message from v_orders")
put("order_fanout_coupon_usage", "coupon_id:i user_id:i order_id:i", """
    select coupon_id, user_id, order_id from v_orders join v_coupons using (coupon_code)""")
put("order_fanout_written", "output:s n_rows:i order_ids:i", """
    select 'orders' "output", count(*) n_rows, sum(order_id) order_ids from v_orders
    union all select 'payments', count(*), sum(order_id) from v_orders
    union all select 'tracking', count(*), sum(order_id) from v_orders
    union all select 'order_items', count(*), sum(order_id) from v_order_items
    union all select 'ledger', count(*), sum(order_id) from v_order_items
    union all select 'coupon_usage', count(*), sum(order_id) from v_orders join v_coupons using (coupon_code)""")
put("purchase_post_headers", "seq:i storeid:i purchase_no:s purchasedate:D", """
    select p_partkey seq, p_size % 4 storeid,
        'PUR' || (9989 + row_number() over (partition by p_size % 4 order by p_partkey)) purchase_no,
        date '2000-01-01' + p_size purchasedate from part""")
put("purchase_post_lines", "seq:i item_no:i purchase_date:D instoreid:i outstoreid:i itmid:i itmname:s unitid:i"
    " stockqty:i rate:d value:d currentstock:i canordersts:i", """
    select p_partkey seq, k item_no, date '2000-01-01' + p_size purchase_date, 1 instoreid, 0 outstoreid,
        p_partkey + k itmid, p_name itmname, p_size % 5 unitid, p_size + k stockqty, p_retailprice rate,
        cast(p_retailprice as decimal(10,2)) * (p_size + k) "value", p_size + k currentstock, 0 canordersts
    from part, (values (0), (1)) c(k) where p_size % 9 <> 0""")
put("flash_sale_post_headers", "seq:i register_id:i flash_no:s from_datetime:t to_datetime:t", """
    select seq, register_id, 'FLS' || case when length(n) >= 4 then n else lpad(n, 4, '0') end flash_no,
        cast(opens as timestamp) from_datetime, cast(opens as timestamp) + interval 3 day to_datetime
    from (select p_partkey seq, p_size % 3 register_id, date '2000-01-01' + p_size opens,
        cast(row_number() over (partition by p_size % 3 order by p_partkey) as varchar) n from part) r""")
put("flash_sale_post_lines", "seq:i item_no:i product_id:i product_rate:d", """
    select p_partkey seq, k item_no, p_partkey + k product_id, p_retailprice - k product_rate
    from part, (values (0), (1), (2)) c(k)""")
put("document_number", "register_id:i order_id:i document_no:s", """
    select register_id, order_id,
        'ORD' || (9900 + row_number() over (partition by register_id order by order_id)) document_no
    from v_orders join v_users using (user_id)""")

# --- catalogue changes

put("category_upsert", "categories_id:i categories_name:s cat_sts:i", """
    with batch as (
        select p_partkey seq, p_partkey % 2 "mode",
            case when p_partkey % 2 = 0 then p_partkey + 100000 else categories_id end id,
            case when p_partkey % 5 = 0 then p_type else p_brand end "name", p_size % 2 sts
        from part join v_products on product_id = p_partkey),
    valid as (
        select b.*, row_number() over (partition by b."name" order by seq) k from batch b
        left join v_categories h on h.categories_name = b."name"
        where h.categories_id is null or ("mode" = 1 and h.categories_id = b.id)),
    last as (select *, row_number() over (partition by id order by seq desc) r from valid where k = 1)
    select coalesce(c.categories_id, l.id) categories_id, coalesce(l."name", c.categories_name) categories_name,
        coalesce(l.sts, c.cat_sts) cat_sts
    from v_categories c full join (select * from last where r = 1) l on l.id = c.categories_id""")
SAVES = """
    select event_id seq, case when event_id % 3 <> 0 then nullif(event_id % 2500, 0) end product_id, event_id + 10000000 new_id,
        trim(case when event_id % 9 = 0 then 'SMALL Ring' when event_id % 3 = 0 then 'New Item ' || (event_id % 400)
            else 'Changed ' || event_id end) title, event_id % 9 categories_id,
        case when event_id % 2 = 0 then event_type else '' end description, floor(value) price,
        case when event_id % 5 <> 0 then floor(value) + 1 else 0 end mrp, event_id % 4 unit,
        case when event_id % 7 <> 0 then event_id % 30 else 0 end lowstqty,
        case when event_id % 10 = 0 then 0 else 1 end itmsts,
        case when event_id % 6 <> 0 then event_id % 20 else 0 end openbalqty,
        case when event_id % 4 = 0 then 'new/' || event_id end image from events"""
NEW_ITEMS = f"""
    select * from (select *, row_number() over (partition by lower(title) order by seq) k from ({SAVES}) s
        where product_id is null and lower(title) not in (select lower(title) from v_products)) r where k = 1"""
UPDATES = f"""
    select * from (select *, row_number() over (partition by product_id order by seq desc) k from ({SAVES}) s
        where product_id in (select product_id from v_products)) r where k = 1"""
ITEM = "title, categories_id, description, price, mrp, unit, lowstqty, itmsts, openbalqty"
put("item_upsert", "product_id:i categories_id:i title:s description:s price:d mrp:d unit:i lowstqty:i itmsts:i"
    " openbalqty:i openbaldate:D", f"""
    select product_id, {ITEM}, openbaldate from v_products
        where product_id not in (select product_id from ({UPDATES}) u)
    union all select product_id, {ITEM}, null from ({UPDATES}) u
    union all select new_id, {ITEM}, null from ({NEW_ITEMS}) n""")
NEW_PICTURES = f"""
    select product_id, image from (
        select product_id, image, row_number() over (partition by product_id order by seq desc) k from (
            select product_id, seq, image from ({SAVES}) s where product_id in (select product_id from v_products)
            union all select new_id, seq, image from ({NEW_ITEMS}) n) a where image is not null) b where k = 1"""
put("item_upsert_images", "product_id:i image_url:s", f"""
    select product_id, image_url from v_images where product_id not in (select product_id from ({NEW_PICTURES}) p)
    union all select product_id, image from ({NEW_PICTURES}) p""")
put("item_upsert_refused", "seq:i reason:s", f"""
    select seq, case when product_id is null then 'Item name already exists' else 'Product not found' end reason
    from ({SAVES}) s where (product_id is null and seq not in (select seq from ({NEW_ITEMS}) n))
        or product_id not in (select product_id from v_products)""")
put("discount_update", "product_id:i title:s discount_per:d discount_sts:i", """
    select p.product_id, p.title,
        case c."mode" when 1 then c.percent when 2 then 0 else p.discount_per end discount_per,
        case c."mode" when 1 then 1 when 2 then 0 else p.discount_sts end discount_sts
    from v_products p left join (
        select event_id % 2500 product_id, event_id % 4 "mode", event_id % 60 percent,
            row_number() over (partition by event_id % 2500 order by event_id desc) k
        from events where event_id % 4 in (1, 2)) c on c.product_id = p.product_id and c.k = 1""")

# --- purchases and orders

LEDGER_SHAPE = "purchase_id:i itmid:i rows:i qty:i item_flags:i order_flags:i last_date:D"


def grouped(body: str) -> str:
    return f"""select purchase_id, itmid, count(*) "rows", sum(stockqty) qty, sum(itmcandel) item_flags,
        sum(canordersts) order_flags, max(purchase_date) last_date from ({body}) l group by 1, 2"""


OWN = "select s_suppkey from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 = 0"
put("purchase_replace_headers", "purchaseid:i purchasedate:D storeid:i", f"""
    select purchaseid, case when purchaseid in ({OWN}) then date '2002-02-02' else purchasedate end purchasedate, storeid
    from v_purchases""")
put("purchase_replace_lines", LEDGER_SHAPE, grouped(f"""
    select purchase_id, itmid, stockqty, itmcandel, canordersts, purchase_date from v_ledger
        where purchase_id not in ({OWN})
    union all select product_id % 120, product_id, 9, 0, 0, date '2002-02-02' from v_products
        where product_id % 120 in ({OWN})"""))
PAIRS = "select distinct event_id % 100 purchase_id, event_id * 7 % 2000 itmid from events"
ACTIVE = "select 1 from v_ledger a where a.purchase_id = p.purchase_id and a.itmid = p.itmid and a.itmcandel = 0"
put("purchase_item_cancel", LEDGER_SHAPE, grouped(f"""
    select s.purchase_id, s.itmid, stockqty, case when g.itmid is not null then 1 else itmcandel end itmcandel,
        canordersts, purchase_date
    from v_ledger s left join (select * from ({PAIRS}) p where exists ({ACTIVE})) g
        on g.purchase_id = s.purchase_id and g.itmid = s.itmid"""))
put("purchase_item_cancel_refused", "purchase_id:i itmid:i", f"select * from ({PAIRS}) p where not exists ({ACTIVE})")
CANCELLED = "select s_suppkey from supplier where s_suppkey % 4 = 0 and s_suppkey % 9 <> 0"
put("purchase_cancel_headers", "purchaseid:i cansts:i", f"""
    select purchaseid, case when purchaseid in ({CANCELLED}) then 1 else cansts end cansts from v_purchases""")
put("purchase_cancel_lines", LEDGER_SHAPE, grouped(f"""
    select purchase_id, itmid, stockqty,
        case when itmcandel = 0 and purchase_id in ({CANCELLED}) then 1 else itmcandel end itmcandel,
        canordersts, purchase_date from v_ledger"""))
GONE = "select event_id * 3 from events"
put("order_cancel_orders", "order_id:i order_status:s", f"""
    select order_id, case when order_id in ({GONE}) then 'cancelled' else order_status end order_status from v_orders""")
put("order_cancel_ledger", LEDGER_SHAPE, grouped(f"""
    select purchase_id, itmid, stockqty, itmcandel, case when orderid in ({GONE}) then 1 else canordersts end canordersts,
        purchase_date from v_ledger"""))
STEPS = """select event_id seq, event_id % 900 order_id,
    case event_type when 'view' then 'out_for_delivery' else 'delivered' end "state",
    coalesce(event_id % 7 <> 0 and event_id % 2 = 0, false) by_partner
    from events where event_type in ('view', 'click')"""
STEPS = f"""
    select * from (select s.*, o.order_status = 'out_for_delivery' was_out,
        lag("state") over (partition by s.order_id order by seq) prev from ({STEPS}) s join v_orders o using (order_id)) e
    where "state" = 'out_for_delivery' or by_partner or coalesce(prev = 'out_for_delivery', was_out)"""
SETTLED = f"select order_id from ({STEPS}) s where by_partner and \"state\" = 'delivered'"
put("order_state_apply_orders", "order_id:i order_status:s payment_status:s", f"""
    select o.order_id, coalesce(e."state", o.order_status) order_status,
        case when o.order_id in ({SETTLED}) then 'complete' else o.payment_status end payment_status
    from v_orders o left join (select order_id, "state", row_number() over (partition by order_id order by seq desc) k
        from ({STEPS}) s) e on e.order_id = o.order_id and e.k = 1""")
put("order_state_apply_payments", "order_id:i method:s status:s", f"""
    select order_id, "method", case when "method" = 'COD' and order_id in ({SETTLED}) then 'complete' else status end status
    from v_payments""")
put("order_state_apply_tracking", "order_id:i status:s seq:i", f"""
    select order_id, "state" status, seq from ({STEPS}) s where "state" = 'out_for_delivery' or not by_partner""")
put("coupon_apply_changes", "coupon_id:i coupon_code:s discount_type:s discount_value:d min_order_value:d"
    " max_discount:d expiry_date:D is_active:b", """
    with gone as (select event_id seq, case when event_id % 2 = 0 then event_id + 999999
        when event_id % 5 = 0 then event_id + 1000001 else event_id % 150 end id from events where event_type = 'error')
    select * from v_coupons where coupon_id not in (select id from gone)
    union all
    select event_id + 1000000, code, case when event_id % 3 = 0 then 'FLAT' else 'PERCENT' end, event_id % 50 + 1,
        case when event_id % 5 <> 0 then event_id % 700 else 0 end, nullif(event_id % 4 * 100, 0),
        case when event_id % 6 <> 0 then date '2003-03-03' end, true
    from (select *, row_number() over (partition by code order by event_id) k from (
            select *, case when event_id % 2 = 0 then 'GIFT' else 'SAVE' end || (event_id % 300) code from events
            where event_type in ('view', 'click')) a
          where code not in (select coupon_code from v_coupons)) b
    where k = 1 and not exists (select 1 from gone where id = event_id + 1000000 and seq > event_id)""")
put("coupon_usage_append", "coupon_id:i user_id:i order_id:i", """
    select coupon_id, user_id, order_id from v_coupon_usage
    union all
    select c.coupon_id, o.user_id, min(o.order_id) from v_orders o
    join v_coupons c on c.coupon_code = 'SAVE' || (o.order_id % 7 * 10)
    where not exists (select 1 from v_coupon_usage u where u.coupon_id = c.coupon_id and u.user_id = o.user_id)
    group by 1, 2""")

# --- people and carts


def cart(before: str) -> str:
    """Each line stepped through its actions one by one; a clear is an action on every line of its user."""
    return f"""
    with recursive own as (
        select event_id seq, user_id, event_id % 5 product_id,
            case event_type when 'view' then 'add' when 'click' then 'set' when 'error' then 'remove' else 'reorder' end op,
            case when event_id % 4 <> 0 then cast(floor(value) as bigint) + 1 when event_type = 'purchase' then 2 end qty
        from events where event_type <> 'signup'),
    start as (select * from ({before}) b),
    pairs as (select user_id, product_id from own union select user_id, product_id from start),
    acts as (
        select * from own union all
        select e.event_id, p.user_id, p.product_id, 'remove', null from events e join pairs p on p.user_id = e.user_id
        where e.event_type = 'signup'),
    numbered as (select *, row_number() over (partition by user_id, product_id order by seq) k from acts),
    walk as (
        select p.user_id, p.product_id, cast(0 as bigint) k, coalesce(s.active, false) is_on,
            s.user_id is not null there, cast(coalesce(s.quantity, 0) as bigint) q
        from pairs p left join start s on s.user_id = p.user_id and s.product_id = p.product_id
        union all
        select w.user_id, w.product_id, n.k,
            case n.op when 'add' then true when 'reorder' then true when 'remove' then false else w.is_on end,
            w.there or n.op in ('add', 'reorder'),
            case when n.op = 'add' and w.is_on then w.q + coalesce(n.qty, 1) when n.op = 'add' then coalesce(n.qty, 1)
                when n.op = 'reorder' then n.qty when n.op = 'set' and w.is_on and n.qty is not null then n.qty
                else w.q end
        from walk w join numbered n on n.user_id = w.user_id and n.product_id = w.product_id and n.k = w.k + 1)
    select user_id, product_id, case when is_on then q end quantity, case when is_on then 'active' else 'removed' end status
    from (select *, row_number() over (partition by user_id, product_id order by k desc) z from walk) r
    where z = 1 and there"""


CART_SHAPE = "user_id:i product_id:i quantity:i status:s"
put("cart_merge", CART_SHAPE, cart("""select c_custkey user_id, c_custkey % 5 product_id, c_custkey % 9 + 1 quantity,
    c_custkey % 3 <> 0 active from customer"""))
put("stream_cart_state", CART_SHAPE, cart("""select c_custkey user_id, c_custkey product_id, c_custkey quantity,
    true active from customer where false"""))
put("favourite_toggle", "user_id:i product_id:i", """
    select user_id, product_id from (
        select user_id, product_id, 1 n from v_favourites
        union all select user_id, event_id % 200, 1 from events where event_type in ('click', 'view')) r
    group by 1, 2 having sum(n) % 2 = 1""")
put("address_apply_changes", "address_id:i user_id:i name:s full_address:s created_at:t", """
    select event_id address_id, user_id,
        case when edited and event_id % 2 = 0 then case when event_id % 8 <> 6 then 'Name ' || event_id end
            else event_type end "name",
        case when edited and event_id % 5 = 1 then 'Second'
            when edited and event_id % 3 = 0 then 'Street ' || event_id
            when event_id % 6 <> 0 then 'No ' || event_id || ', ' || event_type end full_address, ts created_at
    from (select *, event_type in ('view', 'click') and event_id % 4 <> 0 edited from events) e
    where not (event_type = 'error' and event_id % 4 <> 0)
    union all
    select event_id + 10000000, user_id, case when event_id % 8 <> 6 then 'Name ' || event_id end,
        case when event_id % 3 = 0 then 'Third' else 'Street ' || event_id end, ts from events
    where event_type = 'signup' and not (event_id % 5 = 0 and event_id % 2 = 0)""")
put("default_address_set", "address_id:i user_id:i is_default:b", """
    select a.address_id, a.user_id, case when c.chosen is null then a.is_default else a.address_id = c.chosen end is_default
    from v_addresses a left join (select user_id, max(event_id) chosen from events
        where event_id % 3 = 0 and event_id % 4 <> 0 group by 1) c on c.user_id = a.user_id""")
put("profile_update", "address_id:i user_id:i name:s phone:s is_default:b", """
    select a.address_id, a.user_id, case when a.is_default and u.user_id is not null then u."name" else a."name" end "name",
        case when a.is_default and u.user_id is not null then u.phone else a.phone end phone, a.is_default
    from v_addresses a left join v_users u on u.user_id = a.user_id""")
put("review_insert_once", "user_id:i rating:i", """
    select user_id, rating from v_reviews
    union all
    select user_id, rating from (select event_id % 1700 user_id, event_id % 5 + 1 rating,
        row_number() over (partition by event_id % 1700 order by event_id) k from events) r
    where k = 1 and user_id not in (select user_id from v_reviews)""")
put("partner_apply_changes", "driver_id:i full_name:s mobile:s status:i", """
    with batch as (select c_custkey seq, c_custkey % 3 op,
        case when c_custkey % 3 = 0 then c_custkey + 100000 when c_custkey % 3 = 1 and c_custkey % 4 = 1 then c_custkey + 99999
            when c_custkey % 3 = 2 and c_custkey % 8 = 2 then c_custkey + 99998
            when c_custkey % 3 = 2 and c_custkey % 8 = 5 then c_custkey + 100001 else c_custkey % 130 end id, c_name,
        '7' || lpad(cast(c_custkey % 400 as varchar), 9, '0') mobile, c_custkey % 2 status from customer),
    made as (select id, c_name, mobile, seq from (
        select *, row_number() over (partition by mobile order by seq) k from batch
        where op = 0 and mobile not in (select mobile from v_partners)) n where k = 1),
    everyone as (select driver_id, full_name, mobile, status, -1 since from v_partners
        union all select id, c_name, mobile, 1, seq from made)
    select p.driver_id, coalesce(b.c_name, p.full_name) full_name, coalesce(b.mobile, p.mobile) mobile,
        coalesce(b.status, p.status) status
    from everyone p left join batch b on b.seq = (
        select max(seq) from batch x where x.op <> 0 and x.id = p.driver_id and x.seq > p.since)
    where b.op is null or b.op = 1""")
put("walkin_customer_append", "user_id:i name:s phone:s email:s added_by:s user_role:s", """
    select user_id, "name", phone, email, added_by, user_role from v_users
    union all select s_suppkey + 1000000, s_name, cast(s_suppkey as varchar), s_suppkey || '@example.com', 'admin', 'user'
    from supplier""")
put("touch_updated_at", "cart_id:i quantity:i status:s updated_at:t", """
    select cart_id, quantity + case when cart_id % 3 = 0 then 1 else 0 end quantity, status,
        case when cart_id % 3 = 0 then timestamp '2024-06-01 12:00:00' else created_at end updated_at from v_cart""")

# --- streams

put("new_order_feed", "order_id:i register_id:i total_amount:d", """
    select order_id, register_id, total_amount from v_orders join v_users using (user_id)""")
put("stream_daily_revenue", "day:D orders:i revenue:d", """
    select cast(created_at as date) "day", count(*) orders, sum(total_amount) revenue from v_orders group by 1""")
put("stream_stock_level", "product_id:i stock:i", "select product_id, stock from v_stock")
put("stream_order_status", "order_id:i status:s status_at:t", """
    select order_id, lower(status) status, created_at status_at from (
        select *, row_number() over (partition by order_id order by created_at desc, id desc) k from v_tracking) r
    where k = 1""")
