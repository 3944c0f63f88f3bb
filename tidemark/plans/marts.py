"""Marts as DataFrame queries over the retail inputs, each with its checking SQL."""

from __future__ import annotations

from tidemark.plans import layers, quality
from tidemark.sources import retail

#: Name -> (inputs, SELECT). One text for both engines where their SQL agrees.
SHARED: dict[str, tuple[tuple[str, ...], str]] = {}
SHARED["K25"] = (("order_items", "sorders", "products", "geography"), """select g.city, g.region, count(distinct o.order_id) as orders, count(distinct o.customer_id) as customers, round(sum(i.quantity * i.unit_price), 4) as revenue
 from order_items i join sorders o on i.order_id = o.order_id join products p on i.product_id = p.product_id join geography g on o.zip = g.zip
 group by g.city, g.region order by round(sum(i.quantity * i.unit_price), 4) desc, g.city limit 20""")


def mart(key, text, *names):
    SHARED[key] = (names, text)


mart("I01", "select order_id, product_id, order_date, customer_id, zip, order_status, order_payment_method, payment_method_paid, payment_value, installments, device_type, order_source, customer_city, age_group, acquisition_channel, shipping_city, region, district, category, segment, size, color, quantity, line_list_revenue, line_net_revenue, line_cogs, discount_amount, promo_id from lines", "lines")
mart("K13", """select a.order_date as sales_date, a.order_payment_method as payment_method, a.order_count, a.order_line_count, a.revenue, a.cancelled_lines, round(b.avg_payment_value, 4) as avg_payment_value, b.installment_orders
 from (select order_date, order_payment_method, count(distinct order_id) as order_count, count(*) as order_line_count, round(sum(line_net_revenue), 4) as revenue, cast(sum(case when order_status = 'cancelled' then 1 else 0 end) as bigint) as cancelled_lines from lines group by order_date, order_payment_method) a
 left join (select o.order_date, o.payment_method, avg(p.payment_value) as avg_payment_value, cast(sum(case when p.installments > 1 then 1 else 0 end) as bigint) as installment_orders from sorders o join payments p on o.order_id = p.order_id group by o.order_date, o.payment_method) b
 on a.order_date = b.order_date and a.order_payment_method = b.payment_method""", "lines", "sorders", "payments")
mart("K14", """select m.month, round(m.avg_revenue, 4) as avg_revenue, round(t.overall_avg_revenue, 4) as overall_avg_revenue, round(m.avg_revenue / t.overall_avg_revenue, 6) as seasonal_index
 from (select month, avg(revenue) as avg_revenue from (select cast(year(sales_date) as bigint) as year, cast(month(sales_date) as bigint) as month, sum(revenue) as revenue from sales group by year(sales_date), month(sales_date)) y group by month) m
 cross join (select avg(revenue) as overall_avg_revenue from (select sum(revenue) as revenue from sales group by year(sales_date), month(sales_date)) z) t""", "sales")
mart("K21", """select o.order_date as sales_date, o.order_status, count(*) as total_orders, count(s.order_id) as orders_with_shipment, count(*) - count(s.order_id) as orders_without_shipment, round(cast(count(s.order_id) as double) / count(*), 6) as shipment_coverage_rate
 from sorders o left join shipments s on o.order_id = s.order_id group by o.order_date, o.order_status""", "sorders", "shipments")
mart("K22", "select snapshot_date as sales_date, sum(stock_on_hand) as stock_on_hand_total, sum(units_received) as units_received_total, sum(units_sold) as units_sold_total, round(avg(stockout_days), 6) as avg_stockout_days, round(avg(days_of_supply), 6) as avg_days_of_supply, round(avg(fill_rate), 6) as avg_fill_rate, round(avg(sell_through_rate), 6) as avg_sell_through_rate, cast(sum(stockout_flag) as bigint) as stockout_product_count, cast(sum(overstock_flag) as bigint) as overstock_product_count, cast(sum(reorder_flag) as bigint) as reorder_product_count from inventory group by snapshot_date", "inventory")
mart("K23", "select region, category, count(distinct order_id) as orders, round(sum(line_net_revenue), 4) as revenue, cast(sum(quantity) as bigint) as units_sold from lines where region is not null group by region, category", "lines")
mart("K28", "select cast(date_trunc('month', review_date) as date) as month_start_date, p.category, count(*) as review_count, round(avg(rating), 6) as avg_rating, cast(sum(case when rating <= 2 then 1 else 0 end) as bigint) as low_rating_count from reviews r join products p on r.product_id = p.product_id group by cast(date_trunc('month', review_date) as date), p.category", "reviews", "products")
mart("R02", "select distinct acquisition_channel from customers", "customers")
mart("R05", f"select cast(year(order_date) as bigint) as year, count(distinct order_id) as orders, round(sum(line_net_revenue), 4) as revenue from lines group by year(order_date)", "lines")
mart("R04", "select device_type, count(distinct order_id) as orders, round(sum(line_net_revenue) / count(distinct order_id), 4) as avg_order_value from lines group by device_type", "lines")
mart("Q05", "select snapshot_date, product_id from inventory where fill_rate < 0 or fill_rate > 1 or sell_through_rate < 0 or sell_through_rate > 1", "inventory")
mart("Q09", "select i.order_id, i.product_id, i.promo_id from order_items i left join promotions p on i.promo_id = p.promo_id where i.promo_id is not null and p.promo_id is null", "order_items", "promotions")
mart("Q11", "select product_id, round(price, 4) as price, round(cogs, 4) as cogs from products where cogs >= price", "products")
mart("Q12", "select r.return_id from returns r join sorders o on r.order_id = o.order_id where r.return_date < o.order_date", "returns", "sorders")
mart("Q13", "select r.return_id from returns r join sorders o on r.order_id = o.order_id where o.order_status <> 'returned'", "returns", "sorders")
mart("Q14", "select r.review_id from reviews r join sorders o on r.order_id = o.order_id where r.review_date < o.order_date", "reviews", "sorders")
mart("Q15", "select r.review_id from reviews r join sorders o on r.order_id = o.order_id where o.order_status <> 'delivered'", "reviews", "sorders")
mart("Q16", "select s.order_id from shipments s join sorders o on s.order_id = o.order_id where s.ship_date < o.order_date or s.delivery_date < s.ship_date", "shipments", "sorders")
mart("Q17", "select s.order_id from shipments s join sorders o on s.order_id = o.order_id where o.order_status not in ('shipped', 'delivered', 'returned')", "shipments", "sorders")
mart("Q18", "select traffic_date from web_traffic where unique_visitors > sessions or sessions > page_views or bounce_rate < 0 or bounce_rate > 1 or avg_session_duration_sec < 0", "web_traffic")
SHARED |= layers.QUERIES
quality.register(SHARED)


def queries():
    def make(names, text):
        return lambda spark, sf_dir: retail.run(spark, retail.load(spark, sf_dir, names), text)

    return {k: make(names, text) for k, (names, text) in SHARED.items()}


def oracle_sql():
    return {k: f"{retail.ctes(*names)} {retail.spelled(text, 1)}" for k, (names, text) in SHARED.items()}
