"""Schemas of the inputs: fixed, read permissively, never inferred."""

STUDY = """protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string, class: string>>,
  statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, primaryCompletionDateStruct: struct<date: string>,
    studyFirstPostDateStruct: struct<date: string>, lastUpdatePostDateStruct: struct<date: string>>,
  designModule: struct<phases: array<string>, enrollmentInfo: struct<count: int>>,
  conditionsModule: struct<meshes: array<struct<term: string>>, conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<name: string>>>,
  oversightModule: struct<isFdaRegulatedDrug: boolean, isFdaRegulatedDevice: boolean>,
  contactsLocationsModule: struct<locations: array<struct<country: string>>, centralContacts: array<struct<name: string, phone: string, email: string>>>>"""
STUDIES = f"studies array<struct<{STUDY.replace('protocolSection ', 'protocolSection: ', 1)}>>, nextPageToken string"
GRANTS = """results array<struct<appl_id: string, project_num: string, project_title: string, organization: struct<org_name: string, org_city: string, org_state: string, org_url: string>,
  award_amount: decimal(38,2), phr_text: string, fiscal_year: int, award_notice_date: string, date_added: string, activity_code: string, total_cost: decimal(38,2), project_start_date: string>>"""
FILINGS = "hits struct<hits: array<struct<_source: struct<ciks: array<string>, adsh: string, display_names: array<string>, file_date: string, items: array<string>, period_of_report: string>>>>"
DIRECTORY = "`Name` string, `Primary Industry` string, `Size` string, `Type` string, `Location` string, `Country` string, `Domain` string, `LinkedIn URL` string"
CONTACTS = "person_name string, linkedin_url string, original_title string, original_company string, email string, phone string"
JOBS = "job_title string, company_name string, location string, company_domain string, job_url string, date_posted string, received_at timestamp"
CONTACT_UPDATES = "linkedin_url string, title string, company string, location string, received_at timestamp"
COMPANIES = "name string, domain string, company_size string, linkedin_url string, received_at timestamp"
LEAD_CONTACTS = "full_name string, job_title string, location string, company_name string, linkedin_url string, received_at timestamp"
