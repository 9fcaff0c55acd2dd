"""Pieces of pages: chosen links, search addresses, structured data, breadcrumbs, banners and whole pages from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import brand_root, html_escape, json_for_script, long_date


def information_link(hrefs: DataFrame, host: str = "ema.europa.eu") -> DataFrame:
    """(key, href): of (key, ord, href), the first product-information PDF of the host, a French one before others."""
    h = F.trim("href")
    ok = hrefs.filter(F.contains("href", F.lit(host)) & F.lower("href").contains("product-information") & F.lower(h).endswith(".pdf"))
    return ok.groupBy("key").agg(F.min_by(h, F.struct((~F.lower("href").contains("_fr.pdf")).alias("other"), "ord")).alias("href"))


def product_index(records: DataFrame, kind: str = "product-information") -> DataFrame:
    """(brand, url): the first record of each brand out of (ord, type, medicine_name, document_url, translations); French before the original."""
    url = F.coalesce(F.nullif(F.element_at("translations", "fr"), F.lit("")), F.col("document_url"), F.lit(""))
    rows = records.filter(F.col("type") == kind).select(F.trim(F.lower("medicine_name")).alias("brand"), url.alias("url"), "ord").filter("brand <> '' AND url <> ''")
    return rows.groupBy("brand").agg(F.min_by("url", "ord").alias("url"))


def pdf_target(baked: Column, link: Column, name: Column, search: str) -> Column:
    return F.coalesce(F.nullif(baked, F.lit("")), F.nullif(link, F.lit("")), F.concat(F.lit(search), F.url_encode(brand_root(name))))


def search_links(sites: dict[str, str], substance: Column, name: Column) -> Column:
    """map of site -> address, ``{q}`` being the substance, or the brand root without one; null if there is neither."""
    term = F.coalesce(F.nullif(substance, F.lit("")), F.nullif(brand_root(name), F.lit("")))
    q = F.url_encode(F.lower(term))
    return F.when(term.isNotNull(), F.create_map(*[x for site, url in sites.items() for x in (F.lit(site), F.replace(F.lit(url), F.lit("{q}"), q))]))


def drug_json(base: str, path: Column, name: Column, description: Column, substance: Column, holder: Column, reviewed: Column) -> Column:
    """A graph of the drug and its page as JSON that is safe within a script element; empty fields are left out."""
    url = F.concat(F.lit(base), path)
    some = lambda c: F.nullif(c, F.lit(""))
    maker = F.when(some(holder).isNotNull(), F.struct(F.lit("Organization").alias("@type"), holder.alias("name")))
    drug = F.struct(F.lit("Drug").alias("@type"), F.concat(url, F.lit("#drug")).alias("@id"), name.alias("name"), url.alias("url"), some(substance).alias("activeIngredient"), maker.alias("manufacturer"))
    page = F.struct(
        F.lit("MedicalWebPage").alias("@type"), url.alias("@id"), url.alias("url"), F.concat(name, F.lit(" - RCP")).alias("name"), description.alias("description"), F.lit("fr").alias("inLanguage"),
        F.struct(F.concat(url, F.lit("#drug")).alias("@id")).alias("mainEntity"), some(reviewed).alias("lastReviewed"),
    )
    return json_for_script(F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(drug), F.lit(","), F.to_json(page), F.lit("]}")))


def breadcrumb_json(base: str, trail: Column) -> Column:
    """array<struct<label, path>> as a list of items with absolute addresses."""
    items = F.transform(trail, lambda t, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), t["label"].alias("name"), F.concat(F.lit(base), t["path"]).alias("item")))
    return json_for_script(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))))


def breadcrumb(trail: Column) -> Column:
    """The same as a list of links, the last one being text."""
    item = lambda t, i: F.when(
        i == F.size(trail) - 1, F.concat(F.lit('<li aria-current="page">'), html_escape(t["label"]), F.lit("</li>"))
    ).otherwise(F.concat(F.lit('<li><a href="'), html_escape(t["path"]), F.lit('">'), html_escape(t["label"]), F.lit("</a></li>")))
    return F.concat(F.lit("<ol>"), F.array_join(F.transform(trail, item), ""), F.lit("</ol>"))


def date_banner(asof: Column, archived: Column) -> Column:
    day = long_date(F.split_part(asof, F.lit("T"), F.lit(1)))
    text = F.when(archived, F.concat(F.lit("Document archivé, version du "), day)).otherwise(F.concat(F.lit("Version du "), day))
    return F.when(F.coalesce(asof, F.lit("")) != "", F.concat(F.lit('<p class="asof">'), text, F.lit("</p>"))).otherwise("")


def related(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(key, html): links to an entry's targets (key, targets: slugs) in order, with the names of (slug, name)."""
    each = targets.select("key", F.posexplode("targets").alias("ord", "slug")).join(names, "slug")
    link = F.concat(F.lit('<li><a href="/rcp/'), "slug", F.lit('">'), html_escape(F.col("name")), F.lit("</a></li>"))
    return each.groupBy("key").agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", link.alias("h")))), lambda x: x["h"]), ""), F.lit("</ul>")).alias("html"))


def description(name: Column, substances: Column) -> Column:
    """What a search engine shows of an entry's page."""
    known = F.coalesce(substances, F.lit("")) != ""
    return F.concat(
        F.lit("RCP de "), name, F.lit(" : indications, posologie, contre-indications, effets indésirables et interactions."),
        F.when(known, F.concat(F.lit(" Substance active : "), F.lower(substances), F.lit("."))).otherwise(""), F.lit(" Source ANSM / BDPM."),
    )


def central_description(name: Column, full: Column) -> Column:
    """The same of an entry of the central procedure, with its text on the site or only a pointer to it."""
    return F.when(full, F.concat(F.lit("RCP de "), name, F.lit(", médicament autorisé au niveau européen (procédure centralisée EMA), converti depuis le PDF officiel : indications, posologie, effets indésirables. Source EMA."))).otherwise(
        F.concat(name, F.lit(" : médicament à autorisation de mise sur le marché européenne centralisée (EMA). Accès au RCP officiel de l'EMA et aux génériques."))
    )


def site_json(base: str, name: str) -> Column:
    """The site and its search as JSON that is safe within a script element."""
    action = F.struct(F.lit("SearchAction").alias("@type"), F.lit(f"{base}/?q={{search_term_string}}").alias("target"), F.lit("required name=search_term_string").alias("query-input"))
    return json_for_script(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebSite").alias("@type"), F.lit(name).alias("name"), F.lit(f"{base}/").alias("url"), action.alias("potentialAction"))))


WRAPPER = '<div id="textDocument">'


def bake(html: Column, date: Column, fetched: Column, url: Column, archived: Column) -> Column:
    """A converted document with the facts of its capture on its wrapper; an empty document stays empty."""
    attr = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f' {name}="'), html_escape(c), F.lit('"'))).otherwise("")
    tag = F.concat(F.lit(WRAPPER[:-1] + ' data-ema-date="'), F.coalesce(date, F.lit("")), F.lit('"'), attr("data-ema-fetched", fetched), attr("data-ema-pdf", url), F.when(archived, ' data-ema-archive="1"').otherwise(""), F.lit(">"))
    at = F.instr(html, WRAPPER)
    return F.when(at > 0, F.concat(F.left(html, at - 1), tag, F.substring(html, at + len(WRAPPER), F.length(html)))).otherwise(F.coalesce(html, F.lit("")))


def baked(html: Column) -> Column:
    """struct(date, fetched, pdf, archived) of a baked document; what it lacks is empty."""
    of = lambda name: F.coalesce(F.regexp_extract(html, f'data-ema-{name}="([^"]*)"', 1), F.lit(""))
    plain = of("pdf")
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):  # those that bake writes
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.struct(of("date").alias("date"), of("fetched").alias("fetched"), plain.alias("pdf"), F.coalesce(F.contains(html, F.lit('data-ema-archive="1"')), F.lit(False)).alias("archived"))


def stub_body(name: Column, eu: Column, holder: Column, generic: Column, link: Column, search: str) -> Column:
    """The body of a page that only points to the official document: what is known, the way there, and generics on the site."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    facts = F.concat_ws("<br>", F.when(some(eu), F.concat(F.lit("N° d'AMM européenne : <strong>"), html_escape(eu), F.lit("</strong>"))), F.when(some(holder), F.concat(F.lit("Titulaire : "), html_escape(holder))))
    href = F.when(some(link), link).otherwise(F.concat(F.lit(search), F.url_encode(brand_root(name))))
    label = F.when(some(link), "Consulter le RCP officiel (PDF) sur le site de l'EMA →").otherwise("Consulter le RCP officiel sur le site de l'EMA →")
    more = F.concat(F.lit('<p class="stub-generics">Génériques à base de <strong>'), html_escape(F.concat(F.upper(F.left(generic, F.lit(1))), F.lower(F.substring(generic, 2, 10_000)))), F.lit('</strong> disponibles sur ce site : <a href="/?q='), F.url_encode(generic), F.lit('">voir les résultats</a>.</p>'))
    return F.concat(
        F.lit('<div class="rcp-stub">'), F.when(facts != "", F.concat(F.lit('<p class="stub-meta">'), facts, F.lit("</p>"))).otherwise(""),
        F.lit('<p class="stub-actions"><a class="stub-ema" href="'), html_escape(href), F.lit('" target="_blank" rel="noopener">'), label, F.lit("</a></p>"),
        F.when(some(generic), more).otherwise(""), F.lit("</div>"),
    )
