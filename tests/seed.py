"""Shop-shaped seed fixtures: the reference's sample rows, timestamps pinned.

All rows are created at 2024-01-15 10:00:00 UTC; ``AS_OF`` is that date.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from marketlens import schema as S

AS_OF = "2024-01-15"
T0 = dt.datetime(2024, 1, 15, 10, 0, 0)

# Invented contacts; ids and roles are the fixed values of the seed users.
USERS = [
    (1, "Shop Admin", "admin@shop.example", "admin", "9000000001", "Depot 1"),
    (2, "Maker Two", "maker2@shop.example", "artisan", "9000000002", "Workshop 2"),
    (3, "Maker Three", "maker3@shop.example", "artisan", "9000000003", "Workshop 3"),
    (4, "Maker Four", "maker4@shop.example", "artisan", "9000000004", "Workshop 4"),
    (5, "Buyer Five", "buyer5@shop.example", "customer", "9000000005", "Flat 5"),
    (6, "Buyer Six", "buyer6@shop.example", "customer", "9000000006", "Flat 6"),
    (7, "Buyer Seven", "buyer7@shop.example", "customer", "9000000007", "Flat 7"),
]

# Seed products (name, own sample text, price, bulk_price,
# min_bulk_qty, category, artisan_id, image_url, stock, views); ids 1..23.
PRODUCTS = [
    ("Bankura Horse Sculpture", "Sample text 1 on folk.", 1200, 950, 10, "Terracotta Decor", 3, "/images/terracotta1.jpg", 60, 150),
    ("Terracotta Wall Mask", "Sample text 2.", 800, 650, 15, "Terracotta Decor", 3, "/images/terracotta2.jpg", 80, 120),
    ("Handmade Clay Hanging Lamp", "Sample text 3 on lamp.", 1500, 1200, 8, "Terracotta Decor", 3, "/images/terracotta3.jpg", 40, 90),
    ("Rustic Terracotta Planter", "Sample text 4.", 600, 480, 20, "Terracotta Decor", 3, "/images/terracotta4.jpg", 100, 200),
    ("Dokra Tribal Musician Figurine", "Sample text 5 on dokra.", 2200, 1800, 5, "Dokra Metal Art", 3, "/images/dokra1.jpg", 30, 80),
    ("Dokra Bull Sculpture", "Sample text 6 on dokra.", 1800, 1450, 10, "Dokra Metal Art", 3, "/images/dokra2.jpg", 50, 110),
    ("Dokra Pen Stand", "Sample text 7 on dokra.", 700, 560, 25, "Dokra Metal Art", 3, "/images/dokra3.jpg", 70, 60),
    ("Dokra Wall Hanging Plate", "Sample text 8 on dokra.", 1300, 1050, 12, "Dokra Metal Art", 3, "/images/dokra4.jpg", 45, 95),
    ("Kalighat Style Wall Painting", "Sample text 9 on folk.", 2500, 2000, 6, "Folk & Hand-Painted Art", 2, "/images/painting1.jpg", 25, 70),
    ("Pattachitra Art Panel", "Sample text 10.", 1800, 1450, 8, "Folk & Hand-Painted Art", 2, "/images/painting2.jpg", 35, 85),
    ("Hand-Painted Wooden Storage Box", "Sample text 11 on folk.", 900, 720, 15, "Folk & Hand-Painted Art", 2, "/images/box1.jpg", 55, 100),
    ("Kantha Embroidered Cushion Cover", "Sample text 12.", 1200, 960, 10, "Kantha Home Decor", 4, "/images/kantha1.jpg", 40, 130),
    ("Kantha Wall Hanging", "Sample text 13.", 1600, 1280, 8, "Kantha Home Decor", 4, "/images/kantha2.jpg", 30, 75),
    ("Kantha Table Runner", "Sample text 14.", 1000, 800, 12, "Kantha Home Decor", 4, "/images/kantha3.jpg", 50, 90),
    ("Bamboo Hanging Lamp", "Sample text 15 on lamp.", 1100, 880, 10, "Bamboo & Wooden Crafts", 2, "/images/bamboo1.jpg", 60, 140),
    ("Hand-Carved Wooden Mask", "Sample text 16 on folk.", 750, 600, 20, "Bamboo & Wooden Crafts", 2, "/images/wood1.jpg", 80, 110),
    ("Wooden Folk Toy Set", "Sample text 17 on folk.", 500, 400, 30, "Bamboo & Wooden Crafts", 2, "/images/toy1.jpg", 90, 160),
    ("Bamboo Storage Basket", "Sample text 18.", 400, 320, 40, "Bamboo & Wooden Crafts", 2, "/images/basket1.jpg", 120, 180),
    ("Handmade Clay Aroma Diffuser", "Sample text 19.", 550, 440, 25, "Artisan Utility Products", 3, "/images/diffuser1.jpg", 70, 50),
    ("Eco-Friendly Soap Holder", "Sample text 20.", 300, 240, 50, "Artisan Utility Products", 3, "/images/holder1.jpg", 150, 40),
    ("Handmade Paper Journal", "Sample text 21 on folk.", 450, 360, 30, "Artisan Utility Products", 4, "/images/journal1.jpg", 80, 65),
    ("Artisan Desk Organizer", "Sample text 22.", 800, 640, 15, "Artisan Utility Products", 2, "/images/organizer1.jpg", 60, 55),
    ("Decorative Incense Holder", "Sample text 23.", 250, 200, 60, "Artisan Utility Products", 3, "/images/incense1.jpg", 200, 30),
]

# Seed orders (id, customer_id, total, status, shipping address)
# and their lines (order_id, product_id, quantity, unit price).
ORDERS = [
    (1, 5, 5350, "delivered", "Flat 5"),
    (2, 6, 4050, "shipped", "Flat 6"),
    (3, 7, 2400, "confirmed", "Flat 7"),
    (4, 5, 3200, "delivered", "Flat 5"),
]
ORDER_ITEMS = [
    (1, 1, 1, 1, 4500), (2, 1, 7, 1, 850),
    (3, 2, 3, 2, 850), (4, 2, 5, 1, 1800), (5, 2, 6, 1, 550),
    (6, 3, 8, 1, 2400),
    (7, 4, 2, 1, 3200),
]

# Invented wholesale enquiries; categories, quantities and states are fixed values.
ENQUIRIES = [
    (1, "First Trading", "Contact One", "one@trade.example", "9000000011", "Dokra", 500, "First sample message.", "reviewed"),
    (2, "Second Trading", "Contact Two", "two@trade.example", "9000000012", "Terracotta", 200, "Second sample message.", "pending"),
    (3, "Third Trading", "Contact Three", "three@trade.example", "9000000013", "Saree", 150, "Third sample message.", "accepted"),
]

# The five sessions and pages the seed page views cycle through.
SESSIONS = ["sess_a1b2", "sess_c3d4", "sess_e5f6", "sess_g7h8", "sess_i9j0"]
PAGES = ["/", "/products", "/products/3", "/products/5", "/products/1"]


def _page_views():
    rows = []
    for i in range(50):
        user = 5 if i % 3 == 0 else 6 if i % 3 == 1 else None
        product = (i % 5) if i % 5 >= 2 else None
        rows.append((i + 1, SESSIONS[i % 5], user, PAGES[i % 5], product, T0))
    return rows


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    d = Decimal
    users = [(i, n, e, r, p, a, T0) for i, n, e, r, p, a in USERS]
    products = [
        (i + 1, n, desc, d(pr), d(bp), mq, c, a, img, st, v, T0)
        for i, (n, desc, pr, bp, mq, c, a, img, st, v) in enumerate(PRODUCTS)
    ]
    orders = [(i, c, d(t), s, "mock_payment", addr, T0) for i, c, t, s, addr in ORDERS]
    items = [(i, o, p, q, d(pr)) for i, o, p, q, pr in ORDER_ITEMS]
    enquiries = [(*e, T0) for e in ENQUIRIES]
    return {
        "users": spark.createDataFrame(users, S.USERS),
        "products": spark.createDataFrame(products, S.PRODUCTS),
        "orders": spark.createDataFrame(orders, S.ORDERS),
        "order_items": spark.createDataFrame(items, S.ORDER_ITEMS),
        "b2b_enquiries": spark.createDataFrame(enquiries, S.ENQUIRIES),
        "page_views": spark.createDataFrame(_page_views(), S.PAGE_VIEWS),
        "cart_actions": spark.createDataFrame([], S.CART_ACTIONS),
    }
