"""Product catalogue: pages and payloads to product rows, and the price reports.

One pass over the pages: structured data is read first, and only pages without it are parsed as HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrawl import fixed_values as fv
from papertrawl.functions import contacts as C
from papertrawl.functions import dom as D
from papertrawl.functions import text as T

PRODUCT = (
    "struct<product_id:string,title:string,price:double,original_price:double,discount:double,currency:string,"
    "rating:double,review_count:int,availability:string,brand:string,category:string,images:array<string>,"
    "extra_meta:map<string,string>>"
)
_FIELDS = ["product_id", "title", "price", "original_price", "discount", "currency", "rating", "review_count",
           "availability", "brand", "category", "images", "extra_meta"]
_API = (
    "pageData struct<pageContext:struct<productContext:struct<title:string,productName:string,productId:string,"
    "fsn:string,brand:string,inStock:boolean,rating:struct<average:double>,pricing:struct<"
    "finalPrice:struct<value:double>,mrpPrice:struct<value:double>,discount:struct<value:double>>>>>"
)
_MENU = (
    "data struct<cards:array<struct<card:struct<card:struct<info:struct<id:string,name:string,avgRating:double,"
    "cloudinaryImageId:string,cuisines:array<string>>>>>>>"
)
_STATE = ("struct<title:string,name:string,finalPrice:string,mrpPrice:string,rating:double,brand:string,"
          "pid:string,productId:string>")


def _product(title: Column, **values) -> Column:
    """A product struct, null when the title is missing."""
    values = {"currency": F.lit("INR"), "images": F.array(), "extra_meta": F.create_map(), **values}
    parts = [(title if f == "title" else values.get(f, F.lit(None))).alias(f) for f in _FIELDS]
    return F.when(T.is_filled(title), F.struct(*parts).cast(PRODUCT))


def _meta(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def from_jsonld(html: T.ColumnOrName, url: T.ColumnOrName) -> Column:
    """First named Product of the page's ld+json blocks, looked for in @graph lists too."""
    roots = F.filter(C.jsonld_objects(C.jsonld_blocks(html)), lambda v: v.isNotNull())
    objects = F.flatten(F.transform(
        roots, lambda v: F.coalesce(F.try_variant_get(v, "$.@graph", "array<variant>"), F.array(v))
    ))

    def text(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    products = F.filter(
        objects,
        lambda v: text(v, "$.@type").isin("Product", "IndividualProduct") & T.is_filled(text(v, "$.name")),
    )

    def read(v: Column) -> Column:
        offer = F.coalesce(
            F.try_variant_get(v, "$.offers[0]", "variant"), F.try_variant_get(v, "$.offers", "variant")
        )
        images = F.coalesce(
            F.try_variant_get(v, "$.image", "array<string>"),
            F.when(text(v, "$.image").isNotNull(), F.array(text(v, "$.image"))), F.array(),
        )
        asin = T.product_id(url, F.lit("amazon"))
        return _product(
            text(v, "$.name"), product_id=asin, price=F.try_variant_get(offer, "$.price", "double"),
            currency=F.coalesce(text(offer, "$.priceCurrency"), F.lit("INR")),
            rating=F.try_variant_get(v, "$.aggregateRating.ratingValue", "double"),
            review_count=F.coalesce(
                F.try_variant_get(v, "$.aggregateRating.reviewCount", "int"),
                F.try_variant_get(v, "$.aggregateRating.ratingCount", "int"),
            ),
            availability=T.availability_from_schema(text(offer, "$.availability")),
            brand=T.or_blank(text(v, "$.brand.name")), images=images,
            extra_meta=_meta(source=F.lit("json_ld"), asin=asin),
        )

    return D.bind(F.get(products, 0), read)


def from_state(html: T.ColumnOrName) -> Column:
    """First object with a title or name in the state embedded in a page."""
    state = F.from_json(F.regexp_extract(T.col(html), fv.PRODUCT_STATE, 1), "map<string,string>")
    parsed = F.transform(
        F.filter(F.map_values(state), lambda v: v.startswith("{")), lambda v: F.from_json(v, _STATE)
    )
    named = F.get(F.filter(parsed, lambda p: p["title"].isNotNull() | p["name"].isNotNull()), 0)

    def read(p: Column) -> Column:
        pair = F.struct(T.price(p["finalPrice"]).alias("now"), T.price(p["mrpPrice"]).alias("before"))
        return D.bind(pair, lambda x: build(p, x["now"], x["before"]))

    def build(p: Column, now: Column, before: Column) -> Column:
        return _product(
            F.coalesce(T.blank_to_null(p["title"]), p["name"]),
            product_id=F.coalesce(T.blank_to_null(p["pid"]), p["productId"]), price=now, original_price=before,
            discount=T.discount(now, before), rating=p["rating"], availability=F.lit("in_stock"),
            brand=T.or_blank(p["brand"]), extra_meta=_meta(source=F.lit("preloaded_state")),
        )

    return D.bind(named, read)


def from_api(payload: T.ColumnOrName) -> Column:
    """Product context of an intercepted API answer."""
    def read(p: Column) -> Column:
        now, before = p["pricing"]["finalPrice"]["value"], p["pricing"]["mrpPrice"]["value"]
        given = p["pricing"]["discount"]["value"]
        return _product(
            F.coalesce(T.blank_to_null(p["title"]), p["productName"]),
            product_id=F.coalesce(T.blank_to_null(p["productId"]), p["fsn"]), price=now, original_price=before,
            discount=F.coalesce(F.when(given != 0, given), T.discount(now, before)),
            rating=p["rating"]["average"],
            availability=F.when(F.coalesce(p["inStock"], F.lit(False)), "in_stock").otherwise("out_of_stock"),
            brand=T.or_blank(p["brand"]), extra_meta=_meta(source=F.lit("flipkart_api")),
        )

    return D.bind(F.from_json(T.col(payload), _API)["pageData"]["pageContext"]["productContext"], read)


def restaurant_from_payload(payload: T.ColumnOrName) -> Column:
    cards = F.from_json(T.col(payload), _MENU)["data"]["cards"]

    def read(info: Column) -> Column:
        return _product(
            info["name"], product_id=info["id"], rating=info["avgRating"], availability=F.lit("in_stock"),
            brand=info["name"], category=F.lit("Restaurant"),
            images=F.array(T.or_blank(info["cloudinaryImageId"])),
            extra_meta=_meta(cuisines=T.or_blank(F.array_join(info["cuisines"], ", "))),
        )

    return D.bind(F.get(cards, 0)["card"]["card"]["info"], read)


# ---- plain pages ----------------------------------------------------------------------------------


def _texts(dom: Column, selector: str) -> Column:
    return F.transform(D.select(dom, selector), lambda el: D.text_of(dom, el, ""))


def _first_reading(dom: Column, selectors: list[str], pattern: str, attribute: str | None = None) -> Column:
    """Over the first match of each selector, the first text (or attribute) in which the pattern occurs."""
    def text(el: Column) -> Column:
        inner = D.text_of(dom, el, "")
        return inner if attribute is None else F.coalesce(T.blank_to_null(D.attr(el, attribute)), inner)

    texts = F.transform(F.array(*[D.select_one(dom, s) for s in selectors]), text)
    return F.get(F.filter(texts, lambda t: t.rlike(pattern)), 0)


def _image(dom: Column, selectors: list[str], attrs: list[str]) -> Column:
    return F.coalesce(*[
        T.blank_to_null(D.attr(D.select_one(dom, s), a)) for s in selectors for a in attrs
    ])


def _as_list(image: Column) -> Column:
    return F.when(image.isNotNull(), F.array(image)).otherwise(F.array())


def _read_fields(dom: Column, selectors: dict[str, list[str]], **more: Column) -> Column:
    """Raw texts of a shop page, one per field, read once."""
    plain = ["title", "price", "original_price", "discount", "brand"]
    return F.struct(
        *[D.first_text(dom, selectors[f]).alias(f) for f in plain],
        _first_reading(dom, selectors["reviews"], r"[\d,]+").alias("reviews"),
        (F.size(D.select(dom, selectors["cart"][0])) > 0).alias("has_cart"),
        *[c.alias(name) for name, c in more.items()],
    )


def _shop_product(x: Column, price_now: Column, price_before: Column, **values) -> Column:
    given = T.first_number(x["discount"])
    return _product(
        x["title"], price=price_now, original_price=price_before,
        discount=F.coalesce(F.when(given != 0, given), T.discount(price_now, price_before)),
        review_count=T.review_count(x["reviews"]), category=x["crumbs"], images=_as_list(x["image"]), **values,
    )


def _with_prices(raw: Column, build) -> Column:
    """Bind the raw texts, then the two prices read from them."""
    def prices(x: Column) -> Column:
        pair = F.struct(T.price(x["price"]).alias("now"), T.price(x["original_price"]).alias("before"))
        return D.bind(pair, lambda p: build(x, p["now"], p["before"]))

    return D.bind(raw, prices)


def from_amazon_page(dom: Column, url: Column) -> Column:
    s = fv.AMAZON_SELECTORS
    crumbs = D.bind(D.select_one(dom, s["category"][0]), lambda el: F.when(
        el.isNotNull(), D.bind(D.subtree(dom, el), lambda tree: F.array_join(_texts(tree, "li a"), " > "))
    ))
    asin = T.product_id(url, F.lit("amazon"))

    def build(x: Column, now: Column, before: Column) -> Column:
        return _shop_product(
            x, now, before, product_id=asin, rating=T.rating(x["stars"]),
            availability=T.availability_from_text(x["stock"], x["has_cart"]), brand=T.clean_brand(x["brand"]),
            extra_meta=_meta(asin=asin),
        )

    return _with_prices(
        _read_fields(dom, s, crumbs=crumbs, stars=_first_reading(dom, s["rating"], r"[\d.]+", "title"),
                     stock=D.first_text(dom, s["availability"]),
                     image=_image(dom, s["image"], ["data-old-hires", "src"])),
        build,
    )


def from_flipkart_page(dom: Column, url: Column) -> Column:
    s = fv.FLIPKART_SELECTORS
    crumbs = D.bind(
        C.prefer(_texts(dom, s["category"][0]), _texts(dom, s["category"][1])),
        lambda t: F.when(F.size(t) > 0, F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " > ")),
    )

    def build(x: Column, now: Column, before: Column) -> Column:
        stock = F.when(x["has_cart"], "in_stock").when(x["sold_out"], "out_of_stock").otherwise("limited")
        return _shop_product(
            x, now, before, product_id=T.product_id(url, F.lit("flipkart")), rating=T.rating(x["stars"], None),
            availability=stock, brand=T.blank_to_null(T.strip(F.substring_index(x["brand"], "more", 1))),
            extra_meta=_meta(source=F.lit("dom")),
        )

    return _with_prices(
        _read_fields(dom, s, crumbs=crumbs, stars=D.first_text(dom, s["rating"]),
                     sold_out=F.size(D.select(dom, s["sold_out"][0])) > 0,
                     image=_image(dom, s["image"], ["src"])),
        build,
    )


def from_restaurant_page(dom: Column, platform: str) -> Column:
    rest = {"availability": F.lit("in_stock"), "category": F.lit("Restaurant")}
    title = D.text_of(dom, D.select_one(dom, fv.RESTAURANT_TITLE[platform]), "")
    if platform == "swiggy":
        named = F.coalesce(T.blank_to_null(title), F.lit("Unknown"))
        return D.bind(named, lambda name: _product(name, brand=name, **rest))
    number = F.get(F.filter(_texts(dom, "span"), lambda t: t.rlike(r"^[\d.]+$")), 0)
    cuisines = _texts(dom, fv.RESTAURANT_CUISINE)
    return D.bind(title, lambda name: _product(
        name, brand=name, rating=number.try_cast("double"),
        extra_meta=_meta(cuisines=F.array_join(cuisines, ", ")), **rest,
    ))


def from_brand_rules(dom: Column, url: Column, brand: Column, rules=tuple(fv.BRAND_SELECTORS)) -> Column:
    """Title, price, rating and image by the brand's own selectors; a new brand is one more rule."""
    def element(n: int) -> Column:
        return F.coalesce(*[F.when(brand == rule[0], D.select_one(dom, rule[n])) for rule in rules])

    known = brand.isin([r[0] for r in rules])
    title_el = F.coalesce(element(1), F.when(~known, D.select_one(dom, "h1")))
    raw = F.struct(
        F.coalesce(T.blank_to_null(D.text_of(dom, title_el, "")), url).alias("title"),
        D.text_of(dom, element(2), "").alias("price"), D.text_of(dom, element(3), "").alias("stars"),
        T.blank_to_null(D.attr(element(4), "src")).alias("image"),
    )
    return D.bind(raw, lambda x: _product(
        x["title"], price=T.price(x["price"]), rating=T.rating(x["stars"], None), availability=F.lit("in_stock"),
        brand=brand, images=_as_list(x["image"]), extra_meta=_meta(brand=brand),
    ))


def extract_products(pages: DataFrame) -> DataFrame:
    """Pages (url, platform, brand_hint, html, payload, …) to products; pages without a title are dropped.

    Unknown platforms are left to rejected_platforms().
    """
    platform = F.col("platform")
    structured = (
        F.when(platform == "amazon", from_jsonld("html", "url"))
        .when(platform == "flipkart", F.coalesce(from_api("payload"), from_state("html")))
        .when(platform == "swiggy", restaurant_from_payload("payload"))
    )
    dom, url = F.col("dom"), F.col("url")
    from_page = (
        F.when(platform == "amazon", from_amazon_page(dom, url))
        .when(platform == "flipkart", from_flipkart_page(dom, url))
        .when(platform == "swiggy", from_restaurant_page(dom, "swiggy"))
        .when(platform == "zomato", from_restaurant_page(dom, "zomato"))
        .when(platform == "manual", from_brand_rules(dom, url, F.lower("brand_hint")))
    )
    keep = [c for c in pages.columns if c not in ("html", "payload", "brand_hint")]
    return (
        pages.filter(platform.isin(fv.PLATFORMS))
        .withColumn("_structured", structured)
        .withColumn("dom", D.parse_dom(F.when(F.col("_structured").isNull(), F.col("html"))))
        .select(*keep, F.inline(F.filter(F.array(F.coalesce("_structured", from_page)), lambda p: p.isNotNull())))
    )


def rejected_platforms(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("platform").isNull() | ~F.col("platform").isin(fv.PLATFORMS))


def drop_untitled(items: DataFrame) -> DataFrame:
    return items.filter(T.is_filled("title"))


def assign_urls_to_brands(requests: DataFrame, most_brands: int | None = None) -> DataFrame:
    """(job_id, urls, brands) to (job_id, brand, url): each brand takes a contiguous slice of the addresses.

    The last brand also takes what is left over; a brand whose slice is empty takes all addresses. most_brands
    (9 for parity) leaves later brands out. Row-local.
    """
    n, b = F.size("urls"), F.size("brands")
    per = F.greatest(F.lit(1), F.floor(n / b).cast("int"))
    if most_brands is not None:
        requests = requests.withColumn("brands", F.slice("brands", 1, most_brands))
    rows = requests.withColumn("_per", per).withColumn("_last", b - 1)
    by_brand = rows.select("job_id", "urls", "_per", "_last", F.posexplode("brands").alias("_no", "brand"))
    taken = F.when(F.col("_no") == F.col("_last"), F.size("urls")).otherwise(F.col("_per"))
    part = F.slice("urls", F.col("_no") * F.col("_per") + 1, taken)
    return by_brand.select("job_id", "brand", F.explode(C.prefer(part, F.col("urls"))).alias("url"))


# ---- reports --------------------------------------------------------------------------------------


def with_discount(products: DataFrame) -> DataFrame:
    """One derived discount column, used by every report."""
    return products.withColumn(
        "discount", F.coalesce("discount", T.discount(F.col("price"), F.col("original_price")))
    )


def _average(c: str) -> Column:
    """Exact mean of a two-decimal column, so that the order of addition does not matter."""
    exact = F.col(c).cast("decimal(18,2)")
    return F.sum(exact).cast("double") / F.count(exact)


def platform_summary(products: DataFrame) -> DataFrame:
    """Per platform and in total: products, priced, average price, rated, average rating."""
    rows = (
        products.withColumn("platform", F.lower(F.coalesce("platform", F.lit("unknown"))))
        .rollup("platform")
        .agg(
            F.count(F.lit(1)).alias("products"), F.count("price").alias("with_price"),
            _average("price").alias("avg_price"), F.count("rating").alias("with_rating"),
            _average("rating").alias("avg_rating"), F.grouping("platform").alias("is_total"),
        )
    )
    total = F.col("is_total") == 1
    return rows.select(
        F.when(total, "Total").otherwise(T.sentence_case("platform")).alias("platform"), "products",
        *[F.when(~total, F.col(c)).alias(c) for c in ("with_price", "avg_price", "with_rating", "avg_rating")],
    )


def price_analysis(products: DataFrame) -> DataFrame:
    return (
        with_discount(products)
        .groupBy(F.lower(F.coalesce("platform", F.lit("unknown"))).alias("platform"))
        .agg(
            F.min("price").alias("min_price"), F.max("price").alias("max_price"),
            _average("price").alias("avg_price"), F.max("discount").alias("max_discount"),
            _average("discount").alias("avg_discount"),
            F.count_if(F.contains(F.lower(T.or_blank("availability")), F.lit("out"))).alias("out_of_stock"),
        )
        .withColumn("platform", T.sentence_case("platform"))
    )


def product_report_rows(products: DataFrame) -> DataFrame:
    """Display columns of the product sheet."""
    stamp = F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss") if "scraped_at" in products.columns else F.lit("")
    shown = with_discount(products)
    return shown.select(
        T.sentence_case("platform").alias("platform"), F.left("title", F.lit(200)).alias("title"),
        T.or_blank("brand").alias("brand"), T.or_blank("category").alias("category"),
        T.or_blank(T.money(F.col("price"))).alias("price"),
        T.or_blank(T.money(F.col("original_price"))).alias("original_price"),
        T.or_blank(F.concat(F.format_number("discount", 1), F.lit("%"))).alias("discount"),
        T.or_blank(F.when(F.col("rating") != 0, F.format_number("rating", 1))).alias("rating"),
        T.or_blank(F.when(F.col("review_count") != 0, F.col("review_count").cast("string"))).alias("review_count"),
        T.sentence_case(F.replace("availability", F.lit("_"), F.lit(" "))).alias("availability"),
        T.or_blank("product_id").alias("product_id"), "url", stamp.alias("scraped_at"),
    )
