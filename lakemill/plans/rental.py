"""Views and routines over a rental shop.

Functions take an object with the shop's tables as attributes: film, category, film_category,
film_actor, actor, inventory, rental, payment, customer, staff, store, address, city, country.
Payments are summed per inventory item before they meet the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions.scalars import sentence_case
from lakemill.operators import lookups as L
from lakemill.operators.lists import distinct_list, entity_list

C = F.col


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """First and last name with a blank; NULL if either is missing."""
    return F.concat(first, F.lit(" "), last)


def nice_name(separator: str = " ") -> Column:
    """Names in sentence case; some versions of the view join them without a blank."""
    return F.concat(sentence_case("first_name"), F.lit(separator), sentence_case("last_name"))


def places(t) -> DataFrame:
    """Addresses with their city and country."""
    return t.address.join(t.city, "city_id").join(t.country, "country_id")


def _listed(people: DataFrame, t, key: str, *more: Column) -> DataFrame:
    return people.join(places(t), "address_id").select(
        C(key).alias("id"),
        full_name().alias("name"),
        "address",
        C("postal_code").alias("zip code"),
        "phone",
        "city",
        "country",
        *more,
        C("store_id").alias("sid"),
    )


def customer_list(t, active: str = "active") -> DataFrame:
    """Customers with address and a note; `active` names the flag column of the dialect."""
    note = F.when(C(active).cast("boolean"), "active").otherwise("")
    return _listed(t.customer, t, "customer_id", note.alias("notes"))


def staff_list(t) -> DataFrame:
    return _listed(t.staff, t, "staff_id")


def film_list(t, name: Column | None = None, with_actors_only: bool = False) -> DataFrame:
    """Films with category, price and cast; one row per film and category.

    Films without a category or a cast are kept unless `with_actors_only` is set.
    """
    shown = full_name() if name is None else name
    cast = entity_list(
        t.film_actor.select("film_id", "actor_id").join(
            t.actor.select("actor_id", shown.alias("actor_name")), "actor_id"
        ),
        ["film_id"], "actor_name", "actor_id", ", ", "actors",
    )
    categories = t.film_category.select("film_id", "category_id").join(
        t.category.select("category_id", C("name").alias("category")), "category_id", "left"
    )
    films = t.film.join(categories, "film_id", "left")
    return films.join(cast, "film_id", "inner" if with_actors_only else "left").select(
        C("film_id").alias("fid"), "title", "description", "category",
        C("rental_rate").alias("price"), "length", "rating", "actors",
    )


def film_list_nice(t, separator: str = " ") -> DataFrame:
    return film_list(t, nice_name(separator))


def _paid(t) -> DataFrame:
    """(inventory_id, paid): rentals may be paid in parts."""
    per_rental = t.payment.groupBy("rental_id").agg(F.sum("amount").alias("paid"))
    return (
        per_rental.join(t.rental.select("rental_id", "inventory_id"), "rental_id")
        .groupBy("inventory_id")
        .agg(F.sum("paid").alias("paid"))
    )


def sales_by_store(t) -> DataFrame:
    """Total per store, by store id, ordered by country and city."""
    per_store = (
        _paid(t)
        .join(t.inventory.select("inventory_id", "store_id"), "inventory_id")
        .groupBy("store_id")
        .agg(F.sum("paid").alias("total_sales"))
    )
    managers = t.staff.select(
        C("staff_id").alias("manager_staff_id"), full_name().alias("manager")
    )
    return (
        per_store.join(t.store.select("store_id", "address_id", "manager_staff_id"), "store_id")
        .join(places(t).select("address_id", "city", "country"), "address_id")
        .join(managers, "manager_staff_id")
        .orderBy("country", "city", "store_id")
        .select(F.concat_ws(",", "city", "country").alias("store"), "manager", "total_sales")
    )


def sales_by_category(t) -> DataFrame:
    """Total per category; a film in two categories counts in both."""
    per_film = (
        _paid(t)
        .join(t.inventory.select("inventory_id", "film_id"), "inventory_id")
        .groupBy("film_id")
        .agg(F.sum("paid").alias("paid"))
    )
    return (
        per_film.join(t.film_category.select("film_id", "category_id"), "film_id")
        .groupBy("category_id")
        .agg(F.sum("paid").alias("paid"))
        .join(t.category, "category_id")
        .groupBy(C("name").alias("category"))
        .agg(F.sum("paid").alias("total_sales"))
        .orderBy(F.desc("total_sales"), "category")
    )


def _titles(t) -> DataFrame:
    """(actor_id, category, film_id, title) for films with a category."""
    return (
        t.film_actor.select("actor_id", "film_id")
        .join(t.film.select("film_id", "title"), "film_id")
        .join(t.film_category.select("film_id", "category_id"), "film_id")
        .join(t.category.select("category_id", C("name").alias("category")), "category_id")
    )


def actor_info(t) -> DataFrame:
    """Actors with `Category: title, title; Category: ...`; NULL without films."""
    titles = entity_list(
        _titles(t), ["actor_id", "category"], "title", "film_id", ", ", "titles"
    )
    lines = titles.select("actor_id", F.concat_ws(": ", "category", "titles").alias("line"))
    info = distinct_list(lines, ["actor_id"], "line", "; ", "film_info", is_distinct=True)
    return t.actor.join(info, "actor_id", "left").select(
        "actor_id", "first_name", "last_name", "film_info"
    )


def actor_info_json(t) -> DataFrame:
    """Actors with a JSON object of category -> sorted titles."""
    titles = (
        _titles(t)
        .select("actor_id", "category", "title", "film_id")
        .distinct()
        .groupBy("actor_id", "category")
        .agg(F.sort_array(F.collect_list("title")).alias("titles"))
    )
    entries = F.sort_array(F.collect_list(F.struct("category", "titles")))
    info = titles.groupBy("actor_id").agg(
        F.to_json(F.map_from_entries(entries)).alias("film_info")
    )
    return t.actor.join(info, "actor_id", "left").select(
        "actor_id", "first_name", "last_name", "film_info"
    )


def _priced_rentals(t) -> DataFrame:
    films = t.film.select(
        "film_id", C("rental_duration").alias("duration"), C("rental_rate").alias("rate")
    )
    items = t.inventory.select("inventory_id", "film_id").join(films, "film_id")
    return t.rental.join(items, "inventory_id")


def customer_balance(t, as_of: str, customer_id: int | None = None) -> DataFrame:
    """Balance of every customer on a day, or of one."""
    customers = t.customer.select("customer_id")
    if customer_id is not None:
        customers = customers.filter(C("customer_id") == customer_id)
    return L.customer_balance(customers, _priced_rentals(t), t.payment, as_of)


def inventory_in_stock(t) -> DataFrame:
    return L.stock(t.inventory, t.rental).select("inventory_id", "in_stock")


def inventory_held_by(t) -> DataFrame:
    return L.held_by(t.inventory, t.rental, ["rental_date", "rental_id"])


def film_in_stock(t, film_id: int | None = None, store_id: int | None = None) -> DataFrame:
    return L.film_stock(t.inventory, t.rental, True, film_id, store_id)


def film_not_in_stock(t, film_id: int | None = None, store_id: int | None = None) -> DataFrame:
    return L.film_stock(t.inventory, t.rental, False, film_id, store_id)


def rewards_report(
    t, min_purchases: int, min_amount: float, as_of: str, months_back: int = 1
) -> DataFrame:
    return L.rewards_report(t.customer, t.payment, min_purchases, min_amount, as_of, months_back)
