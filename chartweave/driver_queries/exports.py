"""The driver's tables seen as a raw vendor export.

Customers are patients, orders encounters, lineitems observations and scripts,
events script transitions, conversations notes. Cells are re-spelled the way
exports are: padded, null tokens, mixed date spellings, year-1 stamps. Every
row of every table takes part, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartweave.driver_queries.base import load, spread


def spell(date_sql: str, key_sql: str) -> str:
    """A date re-spelled five ways by key; every 13th is the year-1 stamp."""
    return f"""CASE WHEN {key_sql} % 13 = 12 THEN '1/1/0001 12:00:00 AM'
        WHEN {key_sql} % 5 = 0 THEN date_format({date_sql}, 'M/d/yyyy')
        WHEN {key_sql} % 5 = 1 THEN date_format({date_sql}, 'yyyy-MM-dd')
        WHEN {key_sql} % 5 = 2 THEN date_format({date_sql}, 'yyyyMMdd')
        WHEN {key_sql} % 5 = 3 THEN date_format({date_sql}, 'M/d/yyyy h:mm:ss a')
        ELSE concat(date_format({date_sql}, "yyyy-MM-dd'T'HH:mm:ss"), 'Z') END"""


BIRTH = "date_add(DATE'1940-01-01', CAST(c_custkey * 37 % 25000 AS INT))"

TABLE_SQL = {
    "patient-demographics": ("customer", f"""
        concat('p-', c_custkey) AS PatientPracticeGuid,
        CASE WHEN c_custkey % 7 = 0 THEN concat('  ', initcap(c_mktsegment), ' ') ELSE initcap(c_mktsegment) END AS FirstName,
        CASE c_custkey % 3 WHEN 0 THEN '\\\\N' WHEN 1 THEN '' ELSE 'Q' END AS MiddleName,
        c_name AS LastName, CASE WHEN c_custkey % 5 = 0 THEN 'Jr' ELSE 'NULL' END AS NameSuffix,
        CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
        {spell(BIRTH, 'c_custkey')} AS BirthDate,
        CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'True' END AS IsActive,
        concat(c_custkey, ' Main St') AS Address1, CASE WHEN c_custkey % 6 = 0 THEN 'null' ELSE 'Unit 2' END AS Address2,
        concat('City', c_nationkey) AS AddressCity, 'NY' AS AddressState, lpad(c_custkey % 90000, 5, '0') AS AddressZipCode,
        concat('1', lpad(c_custkey, 10, '5')) AS HomePhone, concat('x', c_custkey) AS MobilePhone, '\\\\N' AS OfficePhone,
        concat('u', c_custkey, '@example.com') AS Email,
        CASE WHEN c_custkey % 3 = 0 THEN concat('999-00-', lpad(c_custkey % 10000, 4, '0')) END AS SSN,
        CASE WHEN c_custkey % 4 = 1 THEN concat('first note ', c_custkey) ELSE '' END AS UnPinnedNote,
        CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE '\\\\N' END AS PreferredName, c_custkey AS _ord"""),
    "patient-race": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, concat('Race', (c_nationkey + i) % 5) AS RaceName, c_custkey * 8 + i AS _ord"""),
    "patient-ethnicity": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, concat('Eth', c_nationkey % 3) AS EthnicityName, c_custkey AS _ord"""),
    "patient-gender-identity-sexual-orientation": ("orders", """
        concat('p-', o_custkey) AS PatientPracticeGuid, concat('GI', o_orderkey % 4) AS GenderIdentity,
        CASE WHEN o_orderkey % 2 = 0 THEN 'SO' ELSE 'NULL' END AS SexualOrientation, o_orderkey AS _ord"""),
    "patient-guarantor": ("orders", f"""
        concat('p-', o_custkey) AS PatientPracticeGuid, 'Gee' AS FirstName, concat('Payer', o_orderkey) AS LastName,
        o_orderpriority AS BillingPatientRelationshipOption, CASE WHEN o_orderkey % 3 = 0 THEN 'Self pay' END AS BillingPaymentType,
        {spell('o_orderdate', 'o_orderkey')} AS DateOfBirth, 'Male' AS BillingGenderOption, '\\\\N' AS SSNumber,
        'Line 1' AS Address1, 'Town' AS City, 'NY' AS State, '10001' AS Zip,
        lpad(o_orderkey, 10, '5') AS PrimaryPhoneNumber, '' AS SecondaryPhoneNumber, o_orderkey AS _ord"""),
    "pinned-notes": ("conversations", """
        concat('p-', conv_id) AS PatientPracticeGuid, CASE WHEN role = 'user' THEN 'Call' ELSE '' END AS NoteType,
        text AS NoteText, conv_id * 4096 + turn AS _ord"""),
    "patient-encounters": ("orders", f"""
        concat('p-', o_custkey) AS PatientPracticeGuid, concat('e-', o_orderkey) AS EncounterGuid,
        {spell('o_orderdate', 'o_orderkey')} AS DateOfService,
        CASE WHEN o_orderkey % 10 = 0 THEN 'Growth Chart review' ELSE o_orderpriority END AS ChiefComplaint,
        CASE WHEN o_orderkey % 9 = 0 THEN '<p>&nbsp;</p>' ELSE concat('<p>Status ', o_orderstatus, '</p><p>Total ', CAST(o_totalprice AS DECIMAL(18,2)), '</p>') END AS Subjective,
        '' AS Objective, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'stable' END AS Assessment, '\\\\N' AS Plan,
        concat('s-', o_orderkey % 10) AS SignedByProviderGuid, {spell('o_orderdate', 'o_custkey')} AS SignedDateTimeUtc,
        concat('s-', o_custkey % 10) AS SeenByProviderGuid, concat('f-', o_custkey % 25) AS FacilityGuid,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Office Visit' ELSE '' END AS ChartNoteType,
        CASE WHEN o_orderkey % 3 = 0 THEN 'False' ELSE 'true' END AS IsSoapNote,
        o_orderstatus AS IsVirtualVisit, o_orderkey AS _ord"""),
    "patient-encounter-addendums": ("conversations", """
        concat('e-', conv_id) AS EncounterGuid, concat('<div>', text, '</div>') AS Addendum,
        CASE WHEN turn % 2 = 0 THEN 'Accepted' ELSE '' END AS AmendmentStatus, role AS AmendmentSource,
        '1/2/2024 3:04:05 PM' AS LastModifiedDateTimeUtc, conv_id * 4096 + turn AS _ord"""),
    "patient-encounter-diagnoses": ("lineitem", """
        concat('e-', l_orderkey) AS EncounterGuid,
        CASE WHEN l_linenumber = 7 THEN '\\\\N' ELSE concat('d-', l_partkey) END AS DiagnosisGuid,
        (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS _ord"""),
    "patient-encounter-observations": ("lineitem JOIN orders ON l_orderkey = o_orderkey", f"""
        concat('p-', o_custkey) AS PatientPracticeGuid, concat('e-', l_orderkey) AS EncounterGuid,
        concat('os-', l_orderkey, '-', l_linenumber) AS ObservationSetGuid, 'LOINC' AS ObservationCodeSystem,
        CASE l_linenumber WHEN 1 THEN '8302-2' WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN '3141-9' ELSE '29463-7' END
            WHEN 3 THEN '8480-6' WHEN 4 THEN '8462-4' WHEN 5 THEN '72514-3'
            WHEN 6 THEN CASE WHEN l_partkey % 4 = 0 THEN '39156-5' ELSE '8310-5' END ELSE concat('X-', l_partkey % 3) END AS ObservationCode,
        CASE WHEN l_linenumber = 5 THEN CASE l_partkey % 4 WHEN 0 THEN 'LOINC:LA6113-0' WHEN 1 THEN 'LA10138-8' WHEN 2 THEN '7.6' ELSE 'severe' END
            ELSE CAST(CAST(l_quantity AS INT) + CASE l_linenumber WHEN 1 THEN 40 WHEN 2 THEN 90 WHEN 3 THEN 100 ELSE 50 END AS STRING) END AS Value,
        CASE l_linenumber WHEN 1 THEN 'in' WHEN 2 THEN 'lbs' WHEN 3 THEN 'mmHg' WHEN 4 THEN 'mmHg' ELSE '' END AS UnitOfObservation,
        {spell('l_shipdate', 'l_partkey')} AS ObservationDateTimeUtc, '\\\\N' AS LastModifiedDateTimeUtc,
        CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS Comment, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS _ord"""),
    "patient-diagnoses": ("part", """
        concat('p-', p_partkey % 100) AS PatientPracticeGuid, concat('d-', p_partkey) AS DiagnosisGuid, p_name AS Diagnosis,
        CASE p_partkey % 3 WHEN 0 THEN concat('ICD10:E', lpad(p_size, 2, '0'), '.', p_partkey % 10, ' SNOMED ', 1000000 + p_partkey)
            WHEN 1 THEN concat('SNOMED ', 2000000 + p_partkey) ELSE '\\\\N' END AS DiagnosisCodeEquivalents,
        CASE WHEN p_partkey % 4 = 0 THEN 'Chronic' ELSE '' END AS DiagnosisAcuity,
        date_format(date_add(DATE'2010-01-01', CAST(p_partkey % 3000 AS INT)), 'M/d/yyyy') AS StartDate,
        CASE WHEN p_partkey % 5 = 0 THEN '20200131' ELSE '1/1/0001 12:00:00 AM' END AS StopDate,
        '2024-05-06 07:08:09' AS LastModifiedDateTimeUtc, p_partkey AS _ord"""),
    "patient-allergy": ("supplier", """
        concat('p-', s_suppkey % 50) AS PatientPracticeGuid, concat('a-', s_suppkey) AS AllergyGuid,
        CASE s_suppkey % 4 WHEN 0 THEN 'Drug' WHEN 1 THEN 'FOOD' WHEN 2 THEN 'environment' ELSE 'Pollen' END AS AllergenCategory,
        s_name AS Substance, CASE WHEN s_suppkey % 3 = 0 THEN 'Severe' ELSE 'null' END AS Severity,
        date_format(date_add(DATE'2001-01-01', CAST(s_suppkey AS INT)), 'yyyyMMdd') AS StartDate,
        CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'no' END AS IsActive, s_suppkey AS _ord"""),
    "patient-allergy-reactions": ("lineitem", """
        concat('a-', l_suppkey) AS AllergyGuid, CASE WHEN l_linenumber = 7 THEN '' ELSE concat('Reaction', l_linenumber) END AS Reaction,
        (l_partkey * 100000 + l_orderkey) * 8 + l_linenumber AS _ord"""),
    "patient-medications": ("part", """
        concat('p-', p_partkey % 100) AS PatientPracticeGuid, concat('m-', p_partkey) AS MedicationGuid,
        CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS MedicationName,
        p_type AS GenericName, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_brand END AS TradeName,
        concat(p_size, ' mg') AS ProductStrength, 'Oral' AS Route, CASE WHEN p_partkey % 4 = 0 THEN 'Tablet' ELSE '' END AS DoseForm,
        'take one' AS Sig, '3/4/2015' AS StartDate, CASE WHEN p_partkey % 7 = 0 THEN '2016-05-06' ELSE '' END AS StopDate,
        CASE WHEN p_partkey % 11 = 0 THEN 'Ineffective' ELSE '\\\\N' END AS MedicationDiscontinuedReasonName,
        '\\\\N' AS LastModifiedDateTimeUtc, p_partkey AS _ord"""),
    "patient-prescriptions": ("lineitem JOIN orders ON l_orderkey = o_orderkey", f"""
        concat('p-', o_custkey) AS PatientPracticeGuid, concat('rx-', l_orderkey) AS PrescriptionGuid, concat('m-', l_partkey) AS MedicationGuid,
        concat('s-', l_suppkey % 10) AS PrescribingProviderGuid, CASE WHEN l_linenumber % 3 = 0 THEN 'PrintedPaper' ELSE 'Electronic' END AS DestinationTypeCode,
        {spell('l_shipdate', 'l_suppkey')} AS DateOfService, 'as directed' AS Sig, CAST(CAST(l_quantity AS INT) AS STRING) AS Quantity,
        CASE WHEN l_linenumber = 1 THEN '-1' WHEN l_linenumber = 2 THEN '' ELSE CAST(l_linenumber AS STRING) END AS NumberOfRefills,
        CASE WHEN l_linenumber = 2 THEN '9' ELSE '-1.0' END AS Refills, (l_partkey * 100000 + l_suppkey) * 8 + l_linenumber AS _ord"""),
    "prescription-transactions": ("events", """
        concat('rx-', user_id) AS PrescriptionGuid,
        CASE event_type WHEN 'signup' THEN 'Order Sent' WHEN 'view' THEN 'Refill request received' WHEN 'click' THEN 'Prescription printed'
            WHEN 'purchase' THEN 'Cancellation denied by pharmacy' ELSE 'Unknown step' END AS TransactionDescription,
        CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS Status, '' AS TransactionNote,
        CASE WHEN event_id % 50 = 0 THEN '\\\\N' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END AS TransactionDisplayDateTimeUtc,
        event_id AS _ord"""),
    "patient-insurances": ("customer", f"""
        concat('plan-', c_custkey) AS PatientInsurancePlanGuid, concat('p-', c_custkey % 200) AS PatientPracticeGuid,
        concat('PAYER ', c_nationkey) AS PayerName,
        CASE WHEN c_custkey % 3 = 0 THEN concat('Plan ', c_nationkey, ' (ppo)') ELSE concat('Segment ', c_mktsegment) END AS InsurancePlanName,
        'Medical' AS InsuranceCoverageType, concat('M', c_custkey) AS MemberId, '' AS GroupId,
        CASE c_custkey % 6 WHEN 0 THEN 'Primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'TERTIARY' WHEN 3 THEN 'Other' WHEN 4 THEN 'Weird' ELSE '' END AS OrderOfBenefits,
        '1/5/2012' AS EffectiveFromDate, '' AS EffectiveToDate,
        CASE c_custkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN '25.00' WHEN 2 THEN '12.50' ELSE '\\\\N' END AS CopayFixedAmount,
        CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS InsurancePlanIsActive, 'Acme' AS EmployerName,
        'Self' AS RelationshipToInsured, c_custkey AS _ord"""),
    "superbill-insurances": ("orders", """
        CASE WHEN o_custkey % 4 = 0 THEN concat('plan-', o_custkey) ELSE '' END AS PatientInsurancePlanGuid,
        CASE WHEN o_custkey % 4 = 1 THEN concat('SEGMENT ', CASE o_orderkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END)
             WHEN o_custkey % 4 = 2 THEN concat('Payer ', o_custkey % 12) ELSE 'NULL' END AS PlanName,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('T', o_orderkey % 7) END AS PlanType, o_orderkey AS _ord"""),
    "patient-family-medical-history": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, concat('r-', c_custkey) AS RelativeGuid,
        CASE WHEN c_custkey % 2 = 0 THEN 'Mother' ELSE '' END AS Relationship, c_custkey AS _ord"""),
    "patient-family-history-diagnoses": ("orders", """
        concat('r-', o_custkey) AS RelativeGuid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS Diagnosis,
        CAST(700000 + o_orderkey AS STRING) AS SnomedCode, CASE WHEN o_orderkey % 3 = 0 THEN '4/5/1999' ELSE 'NULL' END AS OnsetDate, o_orderkey AS _ord"""),
    "patient-immunizations": ("part", """
        concat('p-', p_partkey % 100) AS PatientPracticeGuid, concat('i-', p_partkey) AS ImmunizationGuid, p_brand AS Vaccine,
        p_type AS Type, CAST(p_size AS STRING) AS Lot, CASE WHEN p_partkey % 2 = 0 THEN '6/7/2018' ELSE '' END AS DateAdministered,
        CASE WHEN p_partkey % 3 = 0 THEN '20170102' ELSE '\\\\N' END AS AdministeredDate, '2030-01-01' AS ExpirationDate,
        '' AS Comment, p_name AS BodySite, p_partkey AS _ord"""),
    "patient-advance-directives": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, CASE WHEN c_custkey % 3 = 0 THEN 'Living will' ELSE '' END AS Directive,
        '2/3/2019 4:05:06 PM' AS DateRecorded, c_custkey AS _ord"""),
    "patient-documents": ("documents", """
        concat('p-', doc_id % 100) AS PatientPracticeGuid, concat('doc-', doc_id) AS DocumentGuid, concat(source, '-', lang) AS DocumentName,
        lang AS DocumentType, CAST(n_chars AS STRING) AS FileSizeBytes, '20190314135926-0500' AS DocumentDate, doc_id AS _ord"""),
    "providers": ("supplier", """
        concat('s-', s_suppkey) AS ProviderGuid, 'Dr' AS FirstName, s_name AS LastName, 'true' AS IsActive, s_suppkey AS _ord"""),
    "facilities": ("nation", """
        concat('f-', n_nationkey) AS FacilityGuid, n_name AS FacilityName, '1 Clinic Rd' AS Address1, '' AS Address2,
        concat('City', n_nationkey) AS AddressCity, 'NY' AS AddressState, '10001' AS AddressZipCode,
        concat('555-010-', lpad(n_nationkey, 4, '0')) AS PhoneNumber, CAST(n_nationkey AS STRING) AS FaxNumber, CAST(n_nationkey AS BIGINT) AS _ord"""),
    "patient-smokingstatus": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, CASE WHEN c_custkey % 2 = 0 THEN 'Never smoker' ELSE '' END AS TobaccoUseDescription,
        '266919005' AS SnomedCode, '1/2/2020' AS EffectiveDate, c_custkey AS _ord"""),
    "occupation-industry": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, c_mktsegment AS Occupation, CASE WHEN c_custkey % 3 = 0 THEN 'Retail' ELSE '\\\\N' END AS IndustryName,
        '' AS EffectiveDate, '20210304' AS EffectiveDateFrom, c_custkey AS _ord"""),
    "patient-education": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, CASE WHEN c_custkey % 5 = 0 THEN 'College' END AS EducationLevel, '' AS EffectiveDate, c_custkey AS _ord"""),
    "patient-financial-resources": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, CASE WHEN c_custkey % 7 = 0 THEN 'Low' ELSE 'null' END AS FinancialResource,
        '2022-02-02' AS EffectiveDate, c_custkey AS _ord"""),
    "tribal-affiliation": ("customer", """
        concat('p-', c_custkey) AS PatientPracticeGuid, CASE WHEN c_custkey % 50 = 0 THEN 'Affiliation' END AS TribalAffiliation,
        '2022-02-03' AS EffectiveDate, c_custkey AS _ord"""),
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw export table over the driver's tables."""
    source, columns = TABLE_SQL[name]
    for word in source.split():
        if word.islower() and not word.startswith(("l_", "o_")):
            spread(load(spark, sf_dir, word)).createOrReplaceTempView(f"drv_{word}")
    tables = " ".join(f"drv_{w}" if w.islower() and not w.startswith(("l_", "o_")) else w for w in source.split())
    if name == "patient-race":
        tables += " LATERAL VIEW explode(sequence(0, CAST(c_custkey % 3 AS INT))) x AS i"
    return spark.sql(f"SELECT {columns} FROM {tables}")


class DriverExport(dict):
    """Raw tables by name, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = raw_table(self.spark, self.sf_dir, name)
        return self[name]

    def get(self, name, default=None):
        return self[name] if name in TABLE_SQL else default

    def __contains__(self, name) -> bool:
        return name in TABLE_SQL
