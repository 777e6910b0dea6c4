"""Views over employee histories and over a company's locations.

`full_*` and `show_departments` take employees, departments, dept_emp and dept_manager;
`emp_details` takes employees, departments, jobs, locations, countries and regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators import lookups as L
from lakemill.operators.relational import row_count

C = F.col


def employee_names(t) -> DataFrame:
    """(emp_no, emp_name); a missing part of the name is left out."""
    return t.employees.select(
        "emp_no", F.concat_ws(" ", "first_name", "last_name").alias("emp_name")
    )


def employee_departments(t) -> DataFrame:
    """(emp_no, dept_no, dept_name) of the newest department row."""
    return L.latest_department(t.dept_emp).join(t.departments, "dept_no").select(
        "emp_no", "dept_no", "dept_name"
    )


def current_managers(t) -> DataFrame:
    return L.current_manager(t.dept_manager, employee_names(t))


def full_employees(t) -> DataFrame:
    """Employees with the name of their newest department, NULL without one."""
    names = employee_departments(t).select("emp_no", C("dept_name").alias("department"))
    return t.employees.join(names, "emp_no", "left").select(
        "emp_no", "first_name", "last_name", "birth_date", "gender", "hire_date", "department"
    )


def full_departments(t) -> DataFrame:
    return t.departments.join(current_managers(t), "dept_no", "left").select(
        "dept_no", "dept_name", "manager"
    )


def show_departments(t) -> DataFrame:
    """Departments with manager and the number of employees whose current row is there."""
    heads = L.current_department(t.dept_emp).select("emp_no", "dept_no").distinct()
    counts = heads.groupBy("dept_no").agg(row_count().alias("count"))
    return full_departments(t).join(counts, "dept_no")


def emp_details(t) -> DataFrame:
    """Employees with job, department and place; without a department they drop out."""
    places = (
        t.locations.join(t.countries, "country_id")
        .join(t.regions, "region_id")
        .select(
            "location_id", "country_id", "city", "state_province", "country_name", "region_name"
        )
    )
    departments = t.departments.select("department_id", "department_name", "location_id").join(
        places, "location_id"
    )
    return (
        t.employees.join(departments, "department_id")
        .join(t.jobs.select("job_id", "job_title"), "job_id")
        .select(
            "employee_id", "job_id", "manager_id", "department_id", "location_id", "country_id",
            "first_name", "last_name", "salary", "commission_pct", "department_name", "job_title",
            "city", "state_province", "country_name", "region_name",
        )
    )
