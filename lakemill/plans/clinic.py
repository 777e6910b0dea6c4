"""Reports over clinics: patients, appointments, prescriptions, billing and lab referrals of one;
branches, bills and physicians of another; the animals of a third."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.relational import row_count

C = F.col
ZERO = 0


def patients(t) -> DataFrame:
    return t.patients.select(
        "patientid", F.concat("firstname", F.lit(" "), "lastname").alias("full_name")
    )


def owners(t) -> DataFrame:
    """(appointmentid, patientid)."""
    return t.appointments.select("appointmentid", "patientid")


def count_or_zero(name: str):
    return F.coalesce(C(name), F.lit(ZERO)).alias(name)


def patient_visits(t, missed: str = "No-Show") -> DataFrame:
    visits = t.appointments.groupBy("patientid").agg(
        row_count().alias("total_appointments"),
        F.count_if(C("status") == missed).alias("missed_appointments"),
        F.min("appointmentdate").alias("first_visit"),
        F.max("appointmentdate").alias("last_visit"),
    )
    return (
        patients(t)
        .join(visits, "patientid", "left")
        .select(
            "patientid", "full_name", count_or_zero("total_appointments"),
            count_or_zero("missed_appointments"), "first_visit", "last_visit",
        )
        .orderBy(F.desc("total_appointments"), "patientid")
    )


def patient_billing(t, unpaid: str = "Unpaid") -> DataFrame:
    """Bills per patient. The written status does not occur in the data; pass the one that does."""
    per_appointment = t.billing.groupBy("appointmentid").agg(
        row_count().alias("n"),
        F.count("amount").alias("given"),
        F.sum("amount").alias("s"),
        F.sum(F.when(C("status") == unpaid, C("amount")).otherwise(ZERO)).alias("u"),
    )
    per_patient = (
        owners(t)
        .join(per_appointment, "appointmentid")
        .groupBy("patientid")
        .agg(*[F.sum(c).alias(c) for c in ("n", "given", "s", "u")])
    )
    return (
        patients(t)
        .join(per_patient, "patientid", "left")
        .select(
            "patientid", "full_name",
            F.coalesce("n", F.lit(ZERO)).alias("total_bills"),
            C("s").alias("total_amount"),
            F.try_divide(C("s").cast("double"), "given").alias("avg_bill"),
            F.coalesce("u", F.lit(ZERO)).alias("total_unpaid"),
        )
        .orderBy(F.desc_nulls_last("total_amount"), "patientid")
    )


def prescription_history(t) -> DataFrame:
    """Per patient and medication: appointments that prescribed it, first and last day of use."""
    given = t.prescriptions.groupBy("appointmentid", "medicationname").agg(
        F.min("startdate").alias("f"), F.max("enddate").alias("l"), F.lit(1).alias("hit")
    )
    per_patient = (
        owners(t)
        .join(given, "appointmentid", "left")
        .groupBy("patientid", C("medicationname").alias("medication_name"))
        .agg(
            F.count("hit").alias("total_prescriptions"),
            F.min("f").alias("first_use"),
            F.max("l").alias("last_use"),
        )
    )
    return (
        patients(t)
        .join(per_patient, "patientid", "left")
        .select(
            "patientid", "full_name", "medication_name", count_or_zero("total_prescriptions"),
            "first_use", "last_use",
        )
        .orderBy(F.desc("total_prescriptions"), "patientid", "medication_name")
    )


def lab_summary(t) -> DataFrame:
    per_appointment = t.labreferrals.groupBy("appointmentid").agg(
        row_count().alias("total_tests_ordered"),
        F.count_if(C("status") == "Completed").alias("tests_completed"),
        F.count_if(C("status") == "Ordered").alias("tests_pending"),
        F.max("testdate").alias("most_recent_test_date"),
    )
    counts = ("total_tests_ordered", "tests_completed", "tests_pending")
    per_patient = (
        owners(t)
        .join(per_appointment, "appointmentid")
        .groupBy("patientid")
        .agg(
            *[F.sum(c).alias(c) for c in counts],
            F.max("most_recent_test_date").alias("most_recent_test_date"),
        )
    )
    return (
        patients(t)
        .join(per_patient, "patientid", "left")
        .select(
            "patientid", "full_name", *[count_or_zero(c) for c in counts], "most_recent_test_date"
        )
        .orderBy(F.desc("total_tests_ordered"), "patientid")
    )


def staff_load(t) -> DataFrame:
    """Appointments per provider beside the mean over all providers."""
    loads = t.appointments.groupBy("medstaffid").agg(row_count().alias("total_appointments"))
    named = loads.join(t.medicalstaff, "medstaffid").select(
        "medstaffid",
        F.concat("firstname", F.lit(" "), "lastname").alias("med_staff_name"),
        "total_appointments",
    )
    mean = named.agg(F.avg("total_appointments")).scalar()
    return named.withColumn("avg_appointments_all_providers", mean).orderBy(
        F.desc("total_appointments"), "medstaffid"
    )


def monthly_trend(t) -> DataFrame:
    return (
        t.appointments.groupBy(F.month("appointmentdate").alias("month"))
        .agg(
            row_count().alias("appointment_count"),
            F.count_if(C("status") == "No-Show").alias("no_show_count"),
        )
        .orderBy("month")
    )


def medication_top(t) -> DataFrame:
    return (
        t.prescriptions.groupBy(C("medicationname").alias("medication_name"))
        .agg(row_count().alias("times_prescribed"))
        .orderBy(F.desc("times_prescribed"), "medication_name")
    )


def above_average(t) -> DataFrame:
    """Patients billed more than the average billed patient."""
    per_appointment = t.billing.groupBy("appointmentid").agg(F.sum("amount").alias("s"))
    billed = (
        owners(t)
        .join(per_appointment, "appointmentid")
        .groupBy("patientid")
        .agg(F.sum("s").alias("total_billed"))
    )
    mean = billed.agg(F.avg("total_billed")).scalar()
    return (
        billed.filter(C("total_billed") > mean)
        .join(patients(t), "patientid")
        .select(
            "patientid", "full_name", "total_billed", F.round(mean, 2).alias("average_billed")
        )
        .orderBy("patientid")
    )


# ----------------------------------------------------------------------- family clinic


def branch_managers(t) -> DataFrame:
    """Branches with the staff row of their manager."""
    staff = t.staff.select(C("staffid").alias("managerid"), "fname", "lname")
    return t.branch.join(t.manager.select("managerid"), "managerid").join(
        staff, "managerid"
    ).select("branchid", "branchname", "managerid", "fname", "lname")


def patient_bill_total(t, first: str, last: str) -> DataFrame:
    """Sum and number of the bills of the patients of one name; NULL and 0 without any."""
    per_treatment = t.billing.groupBy("treatmentid").agg(
        F.sum("billingamt").alias("s"), row_count().alias("n")
    )
    named = t.patient.filter((C("fname") == first) & (C("lname") == last)).select("patientid")
    return (
        t.treatment.select("treatmentid", "patientid")
        .join(named, "patientid")
        .join(per_treatment, "treatmentid")
        .agg(F.sum("s").alias("billed"), F.coalesce(F.sum("n"), F.lit(ZERO)).alias("bills"))
    )


def physician_departments(t) -> DataFrame:
    return (
        t.employmentrecord.select("physicianid", "deptid")
        .join(t.department.select("deptid", "deptname"), "deptid")
        .join(t.physician.select("physicianid", "fname", "lname"), "physicianid")
        .select("physicianid", "fname", "lname", "deptid", "deptname")
    )


# ------------------------------------------------------------------------------ animals


def animals(t) -> DataFrame:
    return t.animal.join(t.breed, "breedid").join(t.species, "speciesid").select(
        C("name").alias("animal_name"), C("breedname").alias("breed_name"),
        C("speciesname").alias("species_name"),
    )
