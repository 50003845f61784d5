"""Rules of the shops' pages as data: what a card is and where its parts stand.

Shops on a common framework share its rule.  See ``markup.pick`` for how parts are named.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ListingRule:
    card: str
    name: tuple[str, ...]
    link: tuple[str, ...]
    price: tuple[str, ...]
    image: tuple[str, ...] = ("img@src",)
    list_price: tuple[str, ...] = ()
    brand: tuple[str, ...] = ()
    #: Where the stock is told; every place counts.
    stock: tuple[str, ...] = ()
    sold_out: tuple[str, ...] = ("sin stock", "agotad")
    low: tuple[str, ...] = ()
    #: Words that say it is there; where they are given, other words say nothing.
    there: tuple[str, ...] = ()
    #: Stock where nothing is told.
    silent: str = "in-stock"
    #: JSON of variants, which tells the stock where words do not.
    variants: tuple[str, ...] = ()
    low_name: tuple[str, ...] = ()
    sold_out_name: tuple[str, ...] = ()
    #: The name ends before this.
    name_until: str = ""
    #: ars: amounts in local notation; whole: digits before the first comma; amount: the first amount's digits before its comma.
    reading: str = "ars"
    #: Regular expression for the absolute link.
    needs: str = ""
    most: int = 0


@dataclass(frozen=True)
class DetailRule:
    name: tuple[str, ...]
    price: tuple[str, ...]
    image: tuple[str, ...] = ('meta[property="og:image"]@content', "img@src")
    link: tuple[str, ...] = ('link[rel="canonical"]@href',)
    description: tuple[str, ...] = ('meta[name="description"]@content',)
    stock: tuple[str, ...] = ()
    sold_out: tuple[str, ...] = ("sin stock", "agotad")
    low: tuple[str, ...] = ("ultim", "pocas")
    silent: str = "in-stock"
    variants: tuple[str, ...] = ()
    #: The product of a JSON-LD block comes before the page's own parts.
    json_ld: bool = False


# The shops' pages and the frameworks'.
LISTINGS = {
    "mexx": ListingRule(
        ".card.card-ecommerce", (".card-title a", "h4"), (".card-title a@href", ".view.overlay a@href"), ("b, strong",),
        name_until="$", reading="whole", needs=r"(?i)\.html([?#].*)?$", sold_out_name=("sin stock",),
    ),
    "venex": ListingRule(".product-box", ("h3+",), ("a@href", "@href"), (".current-price+", ".price+"), image=("img@data-src", "img@src"), reading="whole", low_name=("outlet",)),
    "fullh4rd": ListingRule(".item", ("h3+", "h2+"), ("a@href",), (".price+",), image=(".image img@src", "img@src"), reading="amount"),
    "gamingcity": ListingRule(
        ".cajasoferta .product, .product", ("h4 a, h4",), ('a[href*="--det--"]@href',), (".price",), image=(".image img@src",),
        stock=(".leyendaConStock, .stock+",), low=("ultim", "pocas"), there=("stock", "disponibles"), silent="unknown",
    ),
    "gezatek": ListingRule(
        ".w-box.product", ("h2",), ("a.click, a[href]@href",), ("h3.precio_web@data-id", "h3.precio_web, h3.price, .price"),
        stock=(".stock_generico",), low=("ultim", "pocas"),
    ),
    "compugarden": ListingRule(
        ".product", (".description h4 a, .description h4, h4 a",), (".image a, .description h4 a@href",), (".price",), image=(".image img@src",),
        stock=(".semaforostock img@src", "input.btn-compra@class"), sold_out=("semaforo3",), low=("semaforo1",), most=10_000_000,
    ),
    "logg": ListingRule(".product-card", (".card-text",), ("@href",), (".logg-price, .card-price",), stock=("*",), low=("quedan pocas",)),
    "xtpc": ListingRule(".product-list", ("h3",), ('a[href*="/prod/"]@href',), (".price~", ".price"), stock=("*",), sold_out=("sin stock", "agotado"), low=("ultim",)),
    "portaltech": ListingRule(
        ".carta-producto", ('meta[itemprop="name"]@content', ".descripcion-producto"), ('a[href*="producto/"]@href', 'meta[itemprop="url"]@content'),
        ('meta[itemprop="price"]@content', ".contenedor-carta-campo-3 > div div"), image=(".imagen-producto img@src", 'meta[itemprop="image"]@content'),
        brand=('meta[itemprop="brand"]@content',), stock=(".badge",), sold_out=("sin stock", "agotado"), low=("stock bajo",),
        there=("stock medio", "stock alto", "disponible"), silent="unknown",
    ),
    "woocommerce": ListingRule(
        "li.type-product, article.type-product, div.type-product",
        (".woocommerce-loop-product__title a+", ".woocommerce-loop-product__title", "h1, h2, h3, h4", "a[href]@title", "img@alt"),
        (".woocommerce-loop-product__title a@href", 'a[href]:not([href^="#"]):not([href^="mailto:"])@href'),
        ("ins .woocommerce-Price-amount bdi, ins bdi", ".woocommerce-Price-amount bdi", "span.amount bdi, span.amount", '.price, [class*="price"]'),
        image=("img@data-src", "img@data-lazy-src", "img@src"), stock=("@class", ".out-of-stock@class"), sold_out=("outofstock", "out-of-stock"),
    ),
    "tiendanube": ListingRule(
        ".js-item-product, .product-item", (".js-item-name, .product-item-name, h2, h3",), ('a.product-item-link, a.js-product-item-image-link-private, a[href*="/productos/"]@href',),
        (".js-price-display, .product-item-price, .price",), image=("img@data-src", "img@data-srcset", "img@srcset", "img@src"),
        stock=(".js-stock-label-private, .text-stock",), sold_out=("sin stock",), variants=("@data-variants",), silent="unknown", needs="/productos/",
    ),
    "prestashop": ListingRule(
        ".product-miniature", (".product-title a, .product-title",), (".product-title a, a.product-thumbnail@href",), (".product-price@content", ".product-price"),
        image=("img@data-full-size-image-url", "img@src"), list_price=(".regular-price",), stock=(".product-availability, .product-availability-list+",),
        sold_out=("no disponible", "sin stock", "agotado"), low=("ultimas", "últimas"), there=("stock", "disponible"), silent="unknown",
    ),
    "qloud": ListingRule(
        ".card-ecommerce", ("h4.card-title a, h4.card-title, .card-title a, .card-title", "img@alt", "img@title"), ('a[href*=".html"]@href',),
        ("[data-precio]@data-precio", "[data-price]@data-price", ".pecio_final b, .main-price .precio, .main-price"), image=("img@data-src", "img@src"),
        list_price=(".precio_mp, .tachado_1, .solo_web.show, .regular-price",), stock=(".articulo_field, .stock, .disponibilidad+",),
        sold_out=("sin stock", "agotado"), low=("ultima",), there=("stock", "deposito", "disponible"), silent="unknown",
    ),
    "foxtienda": ListingRule(
        ".product-card", ("@data-nombre", ".product-card__name h2, .product-card__name"), (".product-card__image a, .product-card__name a@href",), (".product-card__prices",),
        image=(".product-image__img@src",), stock=(".product-card__availability+",), sold_out=("sin stock", "agotado", "no disponible"), low=("ultimas", "últimas"),
        there=("disponible",), silent="unknown",
    ),
}

DETAILS = {
    "woocommerce": DetailRule(
        ("h1.product_title", "h1.entry-title", 'h1[itemprop="name"]'),
        ("p.price ins .woocommerce-Price-amount bdi, .summary ins bdi", "p.price .woocommerce-Price-amount bdi, .summary .woocommerce-Price-amount bdi, .price bdi", 'meta[property="product:price:amount"]@content'),
        image=(".woocommerce-product-gallery__wrapper img@data-large_image", ".woocommerce-product-gallery__wrapper img@src", ".woocommerce-product-gallery img@src", "img.wp-post-image@src"),
        description=(".woocommerce-product-details__short-description", '[itemprop="description"]', 'meta[property="og:description"]@content'),
        stock=(".stock", ".out-of-stock@class"), sold_out=("sin stock", "agotad", "out-of-stock"),
    ),
    "tiendanube": DetailRule(
        ('h1.js-product-name, h1[itemprop="name"], h1',), (".js-price-display, .product-price, .price",),
        image=('meta[property="og:image"]@content', ".js-product-image img, .product-image img, img@src"), link=(),
        description=('meta[name="description"]@content', ".js-product-description, .product-description"), variants=(".js-product-container@data-variants",), silent="unknown", json_ld=True,
    ),
    "foxtienda": DetailRule(
        ('meta[property="og:title"]@content', "title", "h1, .product__name, #NombreWeb, #NombreMobile"),
        ('meta[property="product:price:amount"]@content', 'meta[itemprop="price"]@content', ".product__prices, .product-card__prices"),
        image=('meta[property="og:image"]@content', ".product-image__img, .product__image img@src"), stock=(".product__availability, .text-success, .text-danger",),
        sold_out=("sin stock", "agotado", "no disponible"), low=("ultimas", "últimas"),
    ),
    "xtpc": DetailRule(('meta[property="og:title"]@content', "title", "h1"), (".price~", ".price"), stock=("*",), sold_out=("sin stock", "agotado"), low=("ultim",)),
    "portaltech": DetailRule(
        ("h2.descripcion-producto", 'meta[itemprop="name"]@content'), ('.info-producto-disponible meta[itemprop="price"]@content', ".info-producto-disponible .precio-producto"),
        image=(".contenedor-imagen-principal img@src",), description=('meta[itemprop="description"]@content',), stock=(".info-producto-disponible .badge",),
        sold_out=("sin stock", "agotado"), low=("stock bajo",), silent="unknown",
    ),
}

#: Where a next page is linked, the labels of such links, and the parameters that number pages.
NEXT_LINKS = (
    'a[rel="next"]', "a.next", ".next a", ".pagination a", ".pager a", ".page-item a", ".page-numbers a", ".woocommerce-pagination a",
    'nav[aria-label*="agination"] a', 'nav[aria-label*="aginación"] a', 'nav[aria-label*="aginacion"] a',
)
NEXT_LABELS = (">", ">>", "siguiente", "sig", "next", "›", "»")
PAGE_PARAMETERS = ("page", "paged", "pagina")
#: Where a product page describes the product: its own parts before JSON-LD, its meta descriptions after.
DESCRIPTIONS = (
    ".woocommerce-product-details__short-description", '[itemprop="description"]', ".product-short-description", ".short-description", "#tab-description", "#description",
    ".product-description", ".descripcion", ".descripcion-producto", ".detalle-producto .descripcion", ".summary p", ".product-detail p",
)
META_DESCRIPTIONS = ('meta[property="og:description"]@content', 'meta[name="description"]@content', 'meta[name="twitter:description"]@content')
