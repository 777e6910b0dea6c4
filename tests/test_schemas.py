"""Views and reports over small versions of the source schemas."""

import datetime as dt
import json
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakemill.plans import clinic, company, rental, shop, stays

D, T = dt.date, dt.datetime


def tables(spark, **given):
    """Tables from (schema, rows)."""
    return SimpleNamespace(
        **{name: spark.createDataFrame(rows, schema) for name, (schema, rows) in given.items()}
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain(df):
    """Rows with decimals as floats, in a fixed order."""
    found = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()]
    return sorted(found, key=repr)


# ------------------------------------------------------------------------------ rental


@pytest.fixture(scope="module")
def dvd(spark):
    return tables(
        spark,
        country=("country_id int, country string", [(1, "Canada"), (2, "Australia")]),
        city=("city_id int, city string, country_id int", [(1, "Leth", 1), (2, "Wood", 2)]),
        address=(
            "address_id int, address string, postal_code string, phone string, city_id int",
            [(1, "47 Drive", "T1", "11", 1), (2, "28 Boulevard", "Q4", "22", 2)],
        ),
        store=("store_id int, manager_staff_id int, address_id int", [(1, 1, 1), (2, 2, 2)]),
        staff=(
            "staff_id int, first_name string, last_name string, address_id int, store_id int",
            [(1, "Mi", "Hi", 1, 1), (2, "Jo", "St", 2, 2)],
        ),
        customer=(
            "customer_id int, store_id int, first_name string, last_name string, address_id int,"
            " active int",
            [(1, 1, "MARY", "SMITH", 1, 1), (2, 2, "PAT", "JONES", 2, 0)],
        ),
        category=("category_id int, name string", [(1, "Action"), (2, "Drama")]),
        film=(
            "film_id int, title string, description string, rental_rate decimal(4,2),"
            " rental_duration int, length int, rating string",
            [
                (1, "ALPHA", "a", Decimal("2.99"), 3, 80, "G"),
                (2, "BETA", "b", Decimal("0.99"), 5, 90, "PG"),
                (3, "GAMMA", "c", Decimal("4.99"), 5, 95, "R"),
            ],
        ),
        film_category=("film_id int, category_id int", [(1, 1), (1, 2), (2, 2)]),
        actor=(
            "actor_id int, first_name string, last_name string",
            [(1, "SUE", "DAVIS"), (2, "SUE", "DAVIS"), (3, "BOB", "FOX"), (4, "NO", "FILM")],
        ),
        film_actor=("actor_id int, film_id int", [(1, 1), (2, 1), (3, 1), (3, 2)]),
        inventory=(
            "inventory_id int, film_id int, store_id int",
            [(1, 1, 1), (2, 1, 1), (3, 2, 2), (4, 1, 2), (5, 3, 1)],
        ),
        rental=(
            "rental_id int, rental_date timestamp_ntz, inventory_id int, customer_id int,"
            " return_date timestamp_ntz",
            [
                (1, T(2024, 1, 1), 1, 1, T(2024, 1, 9)),
                (2, T(2024, 1, 2), 2, 1, None),
                (3, T(2024, 1, 3), 3, 2, T(2024, 1, 4)),
                (4, T(2024, 1, 5), 4, 2, None),
                (5, T(2024, 1, 6), 4, 1, None),
            ],
        ),
        payment=(
            "payment_id int, customer_id int, rental_id int, amount decimal(5,2),"
            " payment_date timestamp_ntz",
            [
                (1, 1, 1, Decimal("2.99"), T(2024, 1, 1)), (2, 1, 1, Decimal("5.00"), T(2024, 1, 9)),
                (3, 2, 3, Decimal("0.99"), T(2024, 1, 3)), (4, 1, 2, Decimal("2.00"), T(2024, 2, 1)),
            ],
        ),
    )


def test_customer_and_staff_list(dvd):
    assert rows(rental.customer_list(dvd).orderBy("id")) == [
        (1, "MARY SMITH", "47 Drive", "T1", "11", "Leth", "Canada", "active", 1),
        (2, "PAT JONES", "28 Boulevard", "Q4", "22", "Wood", "Australia", "", 2),
    ]
    staff = rental.staff_list(dvd)
    assert "zip code" in staff.columns
    assert [r.name for r in staff.orderBy("id").collect()] == ["Mi Hi", "Jo St"]


def test_film_list_keeps_films_and_namesakes(dvd):
    got = {(r.title, r.category): r.actors for r in rental.film_list(dvd).collect()}
    cast = "BOB FOX, SUE DAVIS, SUE DAVIS"
    assert got == {
        ("ALPHA", "Action"): cast, ("ALPHA", "Drama"): cast, ("BETA", "Drama"): "BOB FOX",
        ("GAMMA", None): None,
    }
    inner = rental.film_list(dvd, with_actors_only=True)
    assert {r.title for r in inner.collect()} == {"ALPHA", "BETA"}
    nice = {r.title: r.actors for r in rental.film_list_nice(dvd).collect()}
    assert nice["BETA"] == "Bob Fox"
    joined = {r.title: r.actors for r in rental.film_list_nice(dvd, "").collect()}
    assert joined["BETA"] == "BobFox"


def test_sales(dvd):
    assert rows(rental.sales_by_store(dvd)) == [
        ("Wood,Australia", "Jo St", Decimal("0.99")), ("Leth,Canada", "Mi Hi", Decimal("9.99"))
    ]
    assert rows(rental.sales_by_category(dvd)) == [
        ("Drama", Decimal("10.98")), ("Action", Decimal("9.99"))
    ]


def test_actor_info(dvd):
    got = {r.actor_id: r.film_info for r in rental.actor_info(dvd).collect()}
    assert got == {
        1: "Action: ALPHA; Drama: ALPHA", 2: "Action: ALPHA; Drama: ALPHA",
        3: "Action: ALPHA; Drama: ALPHA, BETA", 4: None,
    }
    found = {r.actor_id: r.film_info for r in rental.actor_info_json(dvd).collect()}
    assert json.loads(found[3]) == {"Action": ["ALPHA"], "Drama": ["ALPHA", "BETA"]}
    assert found[4] is None


def test_rental_routines(dvd):
    balance = {r.customer_id: float(r.balance) for r in rental.customer_balance(
        dvd, "2024-01-31").collect()}
    assert balance == {1: 2.99 * 3 + 5 - 7.99, 2: 0.99 + 2.99 - 0.99}
    assert rental.customer_balance(dvd, "2024-01-31", 1).count() == 1
    stock = {r.inventory_id: r.in_stock for r in rental.inventory_in_stock(dvd).collect()}
    assert stock == {1: True, 2: False, 3: True, 4: False, 5: True}
    held = {r.inventory_id: (r.customer_id, r.open_rentals) for r in rental.inventory_held_by(
        dvd).collect()}
    assert held == {1: (None, 0), 2: (1, 1), 3: (None, 0), 4: (1, 2), 5: (None, 0)}
    assert rows(rental.film_in_stock(dvd, 1, 1).select("inventory_id", "film_count")) == [(1, 1)]
    assert rows(rental.film_not_in_stock(dvd, 1).orderBy("store_id").select("inventory_id")) == [
        (2,), (4,)
    ]


def test_rewards_are_strict_and_by_month(dvd):
    ids = lambda *a, **k: [r.customer_id for r in rental.rewards_report(dvd, *a, **k).collect()]
    assert ids(1, 5, "2024-02-15") == [1]
    assert ids(2, 5, "2024-02-15") == []
    assert ids(1, 7.99, "2024-02-15") == []
    assert ids(1, 5, "2024-03-15") == []
    assert ids(1, 5, "2024-04-15", months_back=3) == [1]


# ----------------------------------------------------------------------------- company


def test_employees(spark):
    t = tables(
        spark,
        employees=(
            "emp_no int, birth_date date, first_name string, last_name string, gender string,"
            " hire_date date",
            [(1, None, "A", "One", "F", None), (2, None, "B", "Two", "M", None),
             (3, None, "C", None, "M", None)],
        ),
        departments=("dept_no string, dept_name string", [("d1", "Sales"), ("d2", "Dev")]),
        dept_emp=(
            "emp_no int, dept_no string, from_date date, to_date date",
            [
                (1, "d1", D(2000, 1, 1), D(2005, 1, 1)), (1, "d2", D(2005, 1, 1), D(9999, 1, 1)),
                (2, "d1", D(2000, 1, 1), D(9999, 1, 1)), (2, "d2", D(2001, 1, 1), D(2002, 1, 1)),
            ],
        ),
        dept_manager=(
            "emp_no int, dept_no string, from_date date, to_date date",
            [(1, "d1", D(2000, 1, 1), None), (2, "d1", D(2003, 1, 1), None)],
        ),
    )
    names = {r.emp_no: r.department for r in company.full_employees(t).collect()}
    assert names == {1: "Dev", 2: "Dev", 3: None}
    assert sorted(rows(company.full_departments(t)), key=repr) == [
        ("d1", "Sales", "B Two"), ("d2", "Dev", None)
    ]
    assert rows(company.show_departments(t)) == [("d2", "Dev", None, 1)]
    assert {r.emp_name for r in company.employee_names(t).collect()} == {"A One", "B Two", "C"}


def test_emp_details(spark):
    t = tables(
        spark,
        employees=(
            "employee_id int, first_name string, last_name string, job_id string, salary int,"
            " commission_pct double, manager_id int, department_id int",
            [(1, "A", "B", "j", 10, None, None, 5), (2, "C", "D", "j", 10, None, 1, None)],
        ),
        departments=(
            "department_id int, department_name string, manager_id int, location_id int",
            [(5, "IT", 1, 7)],
        ),
        jobs=("job_id string, job_title string", [("j", "Job")]),
        locations=(
            "location_id int, city string, state_province string, country_id string",
            [(7, "Rome", None, "IT")],
        ),
        countries=("country_id string, country_name string, region_id int", [("IT", "Italy", 1)]),
        regions=("region_id int, region_name string", [(1, "Europe")]),
    )
    got = company.emp_details(t)
    assert len(got.columns) == 16
    assert [(r.employee_id, r.manager_id, r.region_name) for r in got.collect()] == [
        (1, None, "Europe")
    ]


# -------------------------------------------------------------------------------- shop


@pytest.fixture(scope="module")
def orders(spark):
    doc = '{"reviews": [{"rating": 4, "review": "ok"}, {"rating": 9, "review": "fine"}]}'
    return tables(
        spark,
        customers=(
            "customer_id int, email_address string, full_name string", [(1, "a@x", "A"), (2, "b@x", "B")]
        ),
        stores=(
            "store_id int, store_name string, web_address string, physical_address string,"
            " latitude double, longitude double",
            [(1, "Online", "w", None, None, None), (2, "Town", None, "street", 1.0, 2.0)],
        ),
        products=(
            "product_id int, product_name string, product_details binary",
            [(1, "Shoe", doc.encode()), (2, "Hat", b'{"colour": "red"}'), (3, "Belt", None)],
        ),
        orders=(
            "order_id int, order_tms timestamp_ntz, customer_id int, order_status string, store_id int",
            [(1, T(2024, 1, 1), 1, "OPEN", 1), (2, T(2024, 1, 2), 1, "DONE", 1),
             (3, T(2024, 1, 3), 2, "OPEN", 2)],
        ),
        order_items=(
            "order_id int, line_item_id int, product_id int, unit_price decimal(10,2), quantity int",
            [
                (1, 2, 1, Decimal("10.00"), 2), (1, 1, 2, Decimal("1.50"), 1),
                (2, 1, 1, Decimal("10.00"), 1), (3, 1, 3, Decimal("7.00"), 3),
                (3, 2, 1, Decimal("9.00"), 1),
            ],
        ),
    )


def test_customer_order_products(orders):
    got = {r.order_id: (float(r.order_total), r["items"]) for r in
           shop.customer_order_products(orders).collect()}
    assert got == {1: (21.5, "Hat, Shoe"), 2: (10.0, "Shoe"), 3: (30.0, "Belt, Shoe")}
    short = {r.order_id: r["items"] for r in shop.customer_order_products(orders, 5).collect()}
    assert short[1] == "Hat, ...(1)"


def test_store_orders(orders):
    got = {(r.total, r.store_name, r.order_status): (r.order_count, float(r.total_sales))
           for r in shop.store_orders(orders).collect()}
    assert got == {
        ("STORE TOTAL", "Online", None): (2, 31.5), ("STORE TOTAL", "Town", None): (1, 30.0),
        (None, "Online", "OPEN"): (1, 21.5), (None, "Online", "DONE"): (1, 10.0),
        (None, "Town", "OPEN"): (1, 30.0), ("STATUS TOTAL", None, "OPEN"): (2, 51.5),
        ("STATUS TOTAL", None, "DONE"): (1, 10.0), ("GRAND TOTAL", None, None): (3, 61.5),
    }


def test_product_reviews(orders):
    got = shop.product_reviews(orders).select("product_name", "rating", "avg_rating", "review")
    assert sorted(rows(got), key=repr) == [
        ("Hat", None, None, None), ("Shoe", 4, 6.5, "ok"), ("Shoe", 9, 6.5, "fine")
    ]


def test_product_orders(orders):
    assert plain(shop.product_orders(orders)) == [
        ("Belt", "OPEN", 21.0, 1), ("Hat", "OPEN", 1.5, 1), ("Shoe", "DONE", 10.0, 1),
        ("Shoe", "OPEN", 29.0, 2),
    ]


def test_sales_history(spark):
    t = tables(
        spark,
        sales=(
            "prod_id int, cust_id int, time_id date, channel_id int, promo_id int,"
            " quantity_sold int, amount_sold decimal(10,2)",
            [(1, 1, D(2024, 1, 1), 1, 9, 2, Decimal("20.00")),
             (1, 2, D(2024, 1, 1), 2, 9, 1, Decimal("11.00")),
             (2, 1, D(2024, 2, 5), 1, 9, 3, Decimal("5.00"))],
        ),
        costs=(
            "prod_id int, time_id date, promo_id int, channel_id int, unit_cost decimal(10,2),"
            " unit_price decimal(10,2)",
            [(1, D(2024, 1, 1), 9, 1, Decimal("4.00"), Decimal("10.00"))],
        ),
        times=(
            "time_id date, calendar_month_desc string, week_ending_day date",
            [(D(2024, 1, 1), "2024-01", D(2024, 1, 7)), (D(2024, 2, 5), "2024-02", D(2024, 2, 11))],
        ),
        products=("prod_id int, prod_subcategory string", [(1, "S"), (2, "S")]),
    )
    assert [(r.cust_id, float(r.total_cost)) for r in shop.profits(t).collect()] == [(1, 8.0)]
    assert plain(shop.cal_month_sales(t)) == [("2024-01", 31.0), ("2024-02", 5.0)]
    assert plain(shop.fweek_subcat_sales(t).select("week_ending_day", "channel_id", "dollars")) == [
        (D(2024, 1, 7), 1, 20.0), (D(2024, 1, 7), 2, 11.0), (D(2024, 2, 11), 1, 5.0)
    ]


# ------------------------------------------------------------------------------ clinic


@pytest.fixture(scope="module")
def ward(spark):
    return tables(
        spark,
        patients=(
            "patientid int, firstname string, lastname string",
            [(1, "A", "A"), (2, "B", "B"), (3, "C", "C")],
        ),
        medicalstaff=("medstaffid int, firstname string, lastname string", [(7, "X", "Y"), (8, "V", "W")]),
        appointments=(
            "appointmentid int, patientid int, medstaffid int, appointmentdate date, status string",
            [(1, 1, 7, D(2024, 1, 5), "Completed"), (2, 1, 7, D(2025, 1, 9), "No-Show"),
             (3, 2, 8, D(2024, 3, 1), "Completed"), (4, 1, 7, D(2024, 3, 2), "Completed")],
        ),
        prescriptions=(
            "appointmentid int, medicationname string, startdate date, enddate date",
            [(1, "Pill", D(2024, 1, 5), D(2024, 1, 9)), (1, "Pill", D(2024, 1, 6), D(2024, 2, 9)),
             (4, "Pill", D(2024, 3, 2), D(2024, 3, 9)), (4, "Salve", D(2024, 3, 2), None)],
        ),
        billing=(
            "billid int, appointmentid int, amount decimal(8,2), status string",
            [(1, 1, Decimal("10.00"), "Paid"), (2, 4, Decimal("30.00"), "Pending"),
             (3, 3, Decimal("8.00"), "Paid")],
        ),
        labreferrals=(
            "labreferralid int, appointmentid int, status string, testdate date",
            [(1, 1, "Completed", D(2024, 1, 6)), (2, 4, "Ordered", None), (3, 4, "Completed",
                                                                            D(2024, 3, 3))],
        ),
    )


def test_patient_reports(ward):
    assert rows(clinic.patient_visits(ward)) == [
        (1, "A A", 3, 1, D(2024, 1, 5), D(2025, 1, 9)),
        (2, "B B", 1, 0, D(2024, 3, 1), D(2024, 3, 1)),
        (3, "C C", 0, 0, None, None),
    ]
    assert plain(clinic.patient_billing(ward)) == [
        (1, "A A", 2, 40.0, 20.0, 0.0), (2, "B B", 1, 8.0, 8.0, 0.0), (3, "C C", 0, None, None, 0.0)
    ]
    assert [float(r.total_unpaid) for r in clinic.patient_billing(ward, "Pending").collect()] == [
        30.0, 0.0, 0.0
    ]
    assert sorted(rows(clinic.prescription_history(ward)), key=repr) == [
        (1, "A A", "Pill", 2, D(2024, 1, 5), D(2024, 3, 9)),
        (1, "A A", "Salve", 1, D(2024, 3, 2), None),
        (1, "A A", None, 0, None, None),
        (2, "B B", None, 0, None, None),
        (3, "C C", None, 0, None, None),
    ]
    assert rows(clinic.lab_summary(ward)) == [
        (1, "A A", 3, 2, 1, D(2024, 3, 3)), (2, "B B", 0, 0, 0, None), (3, "C C", 0, 0, 0, None)
    ]


def test_clinic_totals(ward):
    assert rows(clinic.staff_load(ward)) == [(7, "X Y", 3, 2.0), (8, "V W", 1, 2.0)]
    assert rows(clinic.monthly_trend(ward)) == [(1, 2, 1), (3, 2, 0)]
    assert rows(clinic.medication_top(ward)) == [("Pill", 3), ("Salve", 1)]
    assert plain(clinic.above_average(ward)) == [(1, "A A", 40.0, 24.0)]


def test_family_clinic_and_animals(spark):
    t = tables(
        spark,
        staff=("staffid string, fname string, lname string", [("S1", "Ann", "Lee"), ("S2", "Bo", "Ray")]),
        manager=("managerid string", [("S1",)]),
        branch=("branchid string, branchname string, managerid string", [("B1", "North", "S1")]),
        patient=("patientid int, fname string, lname string", [(1, "Jo", "Day"), (2, "Al", "Day")]),
        treatment=("treatmentid int, patientid int", [(1, 1), (2, 1), (3, 2)]),
        billing=("treatmentid int, billingamt int", [(1, 5), (1, 6), (2, 7), (3, 50)]),
        physician=("physicianid string, fname string, lname string", [("P1", "Di", "Fox")]),
        department=("deptid string, deptname string", [("D1", "Eye"), ("D2", "Ear")]),
        employmentrecord=("physicianid string, deptid string", [("P1", "D1"), ("P1", "D2")]),
        animal=("animalid int, name string, breedid int", [(1, "Rex", 1)]),
        breed=("breedid int, breedname string, speciesid int", [(1, "Pug", 1)]),
        species=("speciesid int, speciesname string", [(1, "Dog")]),
    )
    assert rows(clinic.branch_managers(t)) == [("B1", "North", "S1", "Ann", "Lee")]
    assert rows(clinic.patient_bill_total(t, "Jo", "Day")) == [(18, 3)]
    assert rows(clinic.patient_bill_total(t, "No", "One")) == [(None, 0)]
    assert sorted(rows(clinic.physician_departments(t))) == [
        ("P1", "Di", "Fox", "D1", "Eye"), ("P1", "Di", "Fox", "D2", "Ear")
    ]
    assert rows(clinic.animals(t)) == [("Rex", "Pug", "Dog")]


def test_bookings(spark):
    b = spark.createDataFrame(
        [("City", "July", 2, 1, 0, 0), ("City", "May", 1, 1, 2, 0), ("Resort", "July", 3, 0, 0, 1)],
        "hotel string, arrival_date_month string, stays_in_week_nights int,"
        " stays_in_weekend_nights int, children int, babies int",
    )
    assert rows(stays.booking_counts(b, "arrival_date_month")) == [("July", 2), ("May", 1)]
    assert rows(stays.night_totals(b)) == [("Resort", 3, 0), ("City", 3, 2)]
    assert rows(stays.family_stays(b).select("children", "babies", F.col(
        "stays_with_children_babies"))) == [(0, 1, 1), (2, 0, 1)]
