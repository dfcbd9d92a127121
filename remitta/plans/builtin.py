"""The built-in specifications of the 835: 5010, what 4010 changes, and the tables of the wide frame.

Element lines read `name TYPE min-max`, with `!` for required and `=` for the codes that are allowed; `-` leaves a
position undefined. Lengths, types and codes follow the public implementation guides of the 835; where the guide leaves
room, the looser choice was taken, so that files in use aren't reported for it.
"""

from __future__ import annotations

from functools import lru_cache


def element(line: str) -> dict | None:
    words = line.split()
    if words == ["-"]:
        return None
    out: dict = {"name": words[0], "type": words[1]}
    for w in words[2:]:
        if w == "!":
            out["required"] = True
        elif w[0] == "=":
            out["codes"] = w[1:].split(",")
        elif w[0] == "/":
            out["scale"] = int(w[1:])
        else:
            out["min"], out["max"] = map(int, w.split("-"))
    return out


def elements(text: str) -> dict:
    lines = [x.strip() for x in text.strip().split(";")]
    return {"elements": {str(i): e for i, x in enumerate(lines, 1) if x and (e := element(x))}}


def composite(name: str, parts: str, required: bool = False) -> dict:
    return {"name": name, "type": "AN", **({"required": True} if required else {}), "composite": elements(parts)["elements"]}


# Positions, names, types and codes of the 835's segments.
_ID_QUALIFIERS = "01,14,20,27,28,29,30,33,ZZ"
_SEGMENTS = {
    "ISA": f"""authorization_information_qualifier ID 2-2 ! =00,03; authorization_information AN 10-10; security_information_qualifier ID 2-2 ! =00,01;
        security_information AN 10-10; sender_id_qualifier ID 2-2 ! ={_ID_QUALIFIERS}; interchange_sender_id AN 15-15 !; receiver_id_qualifier ID 2-2 ! ={_ID_QUALIFIERS};
        interchange_receiver_id AN 15-15 !; interchange_date DT 6-6 !; interchange_time TM 4-4 !; repetition_separator AN 1-1 !; interchange_control_version_number ID 5-5 ! =00501;
        interchange_control_number N0 9-9 !; acknowledgment_requested ID 1-1 ! =0,1; usage_indicator ID 1-1 ! =P,T; component_element_separator AN 1-1""",
    "TA1": """interchange_control_number N0 9-9 !; interchange_date DT 6-6 !; interchange_time TM 4-4 !; interchange_acknowledgment_code ID 1-1 !; interchange_note_code ID 3-3 !""",
    "IEA": "number_of_included_functional_groups N0 1-5 !; interchange_control_number N0 9-9 !",
    "GS": """functional_identifier_code ID 2-2 ! =HP; application_sender_code AN 2-15 !; application_receiver_code AN 2-15 !; date DT 8-8 !; time TM 4-8 !;
        group_control_number N0 1-9 !; responsible_agency_code ID 1-2 ! =X; version_release_industry_identifier AN 1-12 ! =005010X221A1,005010X221,005010""",
    "GE": "number_of_transaction_sets_included N0 1-6 !; group_control_number N0 1-9 !",
    "ST": "transaction_set_identifier_code ID 3-3 ! =835; transaction_set_control_number AN 4-9 !; implementation_convention_reference AN 1-35",
    "SE": "transaction_segment_count N0 1-10 !; transaction_set_control_number AN 4-9 !",
    "BPR": """transaction_handling_code ID 1-2 ! =C,D,H,I,P,U,X; total_actual_provider_payment_amount R 1-18 !; credit_or_debit_flag_code ID 1-1 ! =C,D;
        payment_method_code ID 3-3 ! =ACH,BOP,CHK,FWT,NON; payment_format_code ID 1-10 =CCP,CTX; sender_dfi_identification_number_qualifier ID 2-2 =01,04;
        sender_dfi_identifier AN 3-12; sender_account_number_qualifier ID 1-3 =DA; sender_bank_account_number AN 1-35; originating_company_identifier AN 10-10;
        originating_company_supplemental_code AN 9-9; receiver_dfi_identification_number_qualifier ID 2-2 =01,04; receiver_dfi_identifier AN 3-12;
        receiver_account_number_qualifier ID 1-3 =DA,SG; receiver_account_number AN 1-35; check_issue_or_eft_effective_date DT 8-8 !; business_function_code ID 1-3""",
    "TRN": "trace_type_code ID 1-2 ! =1; check_or_eft_trace_number AN 1-50 !; payer_identifier AN 10-10 !; originating_company_supplemental_code AN 1-50",
    "CUR": "entity_identifier_code ID 2-3 !; currency_code ID 3-3 !; exchange_rate R 4-10 /6",
    "REF": "reference_identification_qualifier ID 2-3 !; reference_identification AN 1-50 !",
    "DTM": "date_time_qualifier ID 3-3 !; date DT 8-8 !",
    "N1": "entity_identifier_code ID 2-3 ! =PE,PR; name AN 1-60 !; identification_code_qualifier ID 1-2; identification_code AN 2-80",
    "N3": "address_line AN 1-55 !; address_line_2 AN 1-55",
    "N4": "city_name AN 2-30 !; state_or_province_code ID 2-2; postal_code ID 3-15; country_code ID 2-3; -; -; country_subdivision_code ID 1-3",
    "PER": """contact_function_code ID 2-2 ! =BL,CX,IC; contact_name AN 1-60; communication_number_qualifier ID 2-2; communication_number AN 1-256;
        communication_number_qualifier_2 ID 2-2; communication_number_2 AN 1-256; communication_number_qualifier_3 ID 2-2; communication_number_3 AN 1-256""",
    "RDM": "report_transmission_code ID 1-2 !; name AN 1-60; communication_number AN 1-256",
    "LX": "assigned_number N0 1-6 !",
    "TS3": """provider_identifier AN 1-50 !; facility_type_code AN 1-2 !; fiscal_period_date DT 8-8 !; total_claim_count R 1-15 !; total_claim_charge_amount R 1-18 !; -; -; -; -; -; -; -;
        total_msp_payer_amount R 1-18; -; total_non_lab_charge_amount R 1-18; -; total_hcpcs_reportable_charge_amount R 1-18; total_hcpcs_payable_amount R 1-18; -; total_professional_component_amount R 1-18;
        total_msp_patient_liability_met_amount R 1-18; total_patient_reimbursement_amount R 1-18; total_pip_claim_count R 1-15; total_pip_adjustment_amount R 1-18""",
    "TS2": """total_drg_amount R 1-18; total_federal_specific_amount R 1-18; total_hospital_specific_amount R 1-18; total_disproportionate_share_amount R 1-18; total_capital_amount R 1-18;
        total_indirect_medical_education_amount R 1-18; total_outlier_day_count R 1-15; total_day_outlier_amount R 1-18; total_cost_outlier_amount R 1-18; average_drg_length_of_stay R 1-15;
        total_discharge_count R 1-15; total_cost_report_day_count R 1-15; total_covered_day_count R 1-15; total_noncovered_day_count R 1-15; total_msp_pass_through_amount R 1-18;
        average_drg_weight R 1-15; total_pps_capital_fsp_drg_amount R 1-18; total_pps_capital_hsp_drg_amount R 1-18; total_pps_dsh_drg_amount R 1-18""",
    "CLP": """claim_submitter_identifier AN 1-38 !; claim_status_code ID 1-2 ! =1,2,3,4,19,20,21,22,23,25; total_claim_charge_amount R 1-18 !; claim_payment_amount R 1-18 !;
        patient_responsibility_amount R 1-18; claim_filing_indicator_code ID 1-2 !; payer_claim_control_number AN 1-50 !; facility_type_code AN 1-2; claim_frequency_code ID 1-1; -;
        diagnosis_related_group_code ID 1-4; diagnosis_related_group_weight R 1-15 /4; discharge_fraction R 1-10 /4; yes_no_condition_or_response_code ID 1-1""",
    "CAS": "claim_adjustment_group_code ID 1-2 ! =CO,OA,PI,PR",
    "NM1": """entity_identifier_code ID 2-3 !; entity_type_qualifier ID 1-1 ! =1,2; last_or_organization_name AN 1-60; first_name AN 1-35; middle_name AN 1-25; name_prefix AN 1-10; name_suffix AN 1-10;
        identification_code_qualifier ID 1-2; identification_code AN 2-80""",
    "MIA": """covered_days_or_visits_count R 1-15 !; pps_operating_outlier_amount R 1-18; lifetime_psychiatric_days_count R 1-15; claim_drg_amount R 1-18; remark_code_1 AN 1-50; claim_disproportionate_share_amount R 1-18;
        claim_msp_pass_through_amount R 1-18; claim_pps_capital_amount R 1-18; pps_capital_fsp_drg_amount R 1-18; pps_capital_hsp_drg_amount R 1-18; pps_capital_dsh_drg_amount R 1-18; old_capital_amount R 1-18;
        pps_capital_ime_amount R 1-18; pps_operating_hospital_specific_drg_amount R 1-18; cost_report_day_count R 1-15; pps_operating_federal_specific_drg_amount R 1-18; claim_pps_capital_outlier_amount R 1-18;
        claim_indirect_teaching_amount R 1-18; nonpayable_professional_component_amount R 1-18; remark_code_2 AN 1-50; remark_code_3 AN 1-50; remark_code_4 AN 1-50; remark_code_5 AN 1-50; pps_capital_exception_amount R 1-18""",
    "MOA": """reimbursement_rate R 1-10 /4; claim_hcpcs_payable_amount R 1-18; remark_code_1 AN 1-50; remark_code_2 AN 1-50; remark_code_3 AN 1-50; remark_code_4 AN 1-50; remark_code_5 AN 1-50;
        claim_esrd_payment_amount R 1-18; nonpayable_professional_component_amount R 1-18""",
    "AMT": "amount_qualifier_code ID 1-3 !; monetary_amount R 1-18 !",
    "QTY": "quantity_qualifier ID 2-2 !; quantity R 1-15 !",
    "LQ": "code_list_qualifier_code ID 1-3 ! =HE,RX; industry_code AN 1-30 !",
}
_SVC_PARTS = "product_or_service_id_qualifier ID 2-2 !; procedure_code AN 1-48 !; procedure_modifier_1 AN 2-2; procedure_modifier_2 AN 2-2; procedure_modifier_3 AN 2-2; procedure_modifier_4 AN 2-2; procedure_code_description AN 1-80; product_or_service_id AN 1-48"
_PLB_PARTS = "adjustment_reason_code ID 2-2 !; provider_adjustment_identifier AN 1-50"


def _segments() -> dict:
    out = {k: elements(v) for k, v in _SEGMENTS.items()}
    cas = out["CAS"]["elements"]
    for i in range(6):  # up to six adjustments of a reason, an amount and a quantity
        n, must = i + 1, {"required": True} if i == 0 else {}
        cas[str(3 * i + 2)] = {"name": f"adjustment_reason_code_{n}", "type": "ID", "min": 1, "max": 5, **must}
        cas[str(3 * i + 3)] = {"name": f"adjustment_amount_{n}", "type": "R", "min": 1, "max": 18, **must}
        cas[str(3 * i + 4)] = {"name": f"adjustment_quantity_{n}", "type": "R", "min": 1, "max": 15}
    svc = {"1": composite("composite_medical_procedure_identifier", _SVC_PARTS, True)}
    svc |= {"2": element("line_item_charge_amount R 1-18 !"), "3": element("line_item_provider_payment_amount R 1-18 !"), "4": element("national_uniform_billing_committee_revenue_code AN 1-48")}
    svc |= {"5": element("units_of_service_paid_count R 1-15"), "6": composite("original_composite_medical_procedure_identifier", _SVC_PARTS), "7": element("original_units_of_service_count R 1-15")}
    plb = {"1": element("provider_identifier AN 1-50 !"), "2": element("fiscal_period_date DT 8-8 !")}
    for i in range(6):
        must = i == 0
        plb[str(2 * i + 3)] = composite(f"adjustment_identifier_{i + 1}", _PLB_PARTS, must)
        plb[str(2 * i + 4)] = {"name": f"provider_adjustment_amount_{i + 1}", "type": "R", "min": 1, "max": 18, **({"required": True} if must else {})}
    return out | {"SVC": {"elements": svc}, "PLB": {"elements": plb}}


def occurrence(segment: str, pos: int, most: int | None = None, needed: bool = False, where: str | None = None, codes: dict | None = None) -> dict:
    """where: element=codes that tell the occurrence from others of the same segment."""
    out: dict = {"segment": segment, "pos": pos}
    if needed:
        out["usage"] = "required"
    if most:
        out["max"] = most
    if where:
        at, _, listed = where.partition("=")
        out["qualifier"] = {"element": int(at), "codes": listed.split(",")}
    if codes:
        out["codes"] = {k: v.split(",") for k, v in codes.items()}
    return out


_o = occurrence
# The places of segments in the loops, in the order of the guide.
_LOOPS = {
    "interchange": {"trigger": {"segment": "ISA"}, "end": "IEA", "usage": "required", "control": {"opener_element": 13, "closer_element": 2, "count_element": 1, "count": "children"}, "occurrences": {
        "interchange_control_header": _o("ISA", 1, 1, True), "interchange_acknowledgment": _o("TA1", 2), "interchange_control_trailer": _o("IEA", 99990, 1, True)}},
    "group": {"parent": "interchange", "trigger": {"segment": "GS"}, "end": "GE", "usage": "required", "control": {"opener_element": 6, "closer_element": 2, "count_element": 1, "count": "children"}, "occurrences": {
        "functional_group_header": _o("GS", 1, 1, True), "functional_group_trailer": _o("GE", 99980, 1, True)}},
    "transaction": {"parent": "group", "trigger": {"segment": "ST"}, "end": "SE", "usage": "required", "control": {"opener_element": 2, "closer_element": 2, "count_element": 1, "count": "segments"}, "occurrences": {
        "transaction_set_header": _o("ST", 1, 1, True), "financial_information": _o("BPR", 10200, 1, True), "reassociation_trace_number": _o("TRN", 10400, 1, True), "foreign_currency_information": _o("CUR", 10500, 1),
        "receiver_identification": _o("REF", 10600, 1, where="1=EV"), "version_identification": _o("REF", 10600, 1, where="1=F2"), "production_date": _o("DTM", 10700, 1, where="1=405"),
        "provider_adjustment": _o("PLB", 30100), "transaction_set_trailer": _o("SE", 30200, 1, True)}},
    "1000A": {"parent": "transaction", "trigger": {"segment": "N1", "where": {"1": "PR"}}, "usage": "required", "max": 1, "occurrences": {
        "payer_identification": _o("N1", 10800, 1, True, codes={"3": "XV"}), "payer_address": _o("N3", 11000, 1, True), "payer_city_state_zip_code": _o("N4", 11100, 1, True),
        "additional_payer_identification": _o("REF", 11200, 4), "payer_business_contact_information": _o("PER", 11300, 1, where="1=CX"),
        "payer_technical_contact_information": _o("PER", 11300, needed=True, where="1=BL"), "payer_web_site": _o("PER", 11300, 1, where="1=IC")}},
    "1000B": {"parent": "transaction", "trigger": {"segment": "N1", "where": {"1": "PE"}}, "usage": "required", "max": 1, "occurrences": {
        "payee_identification": _o("N1", 10800, 1, True, codes={"3": "FI,XV,XX"}), "payee_address": _o("N3", 11000, 1), "payee_city_state_zip_code": _o("N4", 11100, 1),
        "payee_additional_identification": _o("REF", 11200), "remittance_delivery_method": _o("RDM", 11400, 1)}},
    "2000": {"parent": "transaction", "trigger": {"segment": "LX"}, "occurrences": {
        "header_number": _o("LX", 20030, 1, True), "provider_summary_information": _o("TS3", 20050, 1), "provider_supplemental_summary_information": _o("TS2", 20070, 1)}},
    "2100": {"parent": "2000", "trigger": {"segment": "CLP"}, "usage": "required", "occurrences": {
        "claim_payment_information": _o("CLP", 20100, 1, True), "claim_adjustment": _o("CAS", 20200, 99), "patient_name": _o("NM1", 20300, 1, True, "1=QC"), "insured_name": _o("NM1", 20300, 1, where="1=IL"),
        "corrected_patient_or_insured_name": _o("NM1", 20300, 1, where="1=74"), "service_provider_name": _o("NM1", 20300, 1, where="1=82"), "crossover_carrier_name": _o("NM1", 20300, 1, where="1=TT"),
        "corrected_priority_payer_name": _o("NM1", 20300, 1, where="1=PR"), "other_subscriber_name": _o("NM1", 20300, 1, where="1=GB"),
        "inpatient_adjudication_information": _o("MIA", 20330, 1), "outpatient_adjudication_information": _o("MOA", 20350, 1),
        "other_claim_related_identification": _o("REF", 20400, 5, where="1=1L,1W,28,6P,9A,9C,BB,CE,EA,F8,G1,G3,IG,SY"), "rendering_provider_identification": _o("REF", 20400, 10, where="1=0B,1A,1B,1C,1D,1G,1H,1J,D3,G2,LU"),
        "statement_from_or_to_date": _o("DTM", 20500, 2, where="1=232,233"), "coverage_expiration_date": _o("DTM", 20500, 1, where="1=036"), "claim_received_date": _o("DTM", 20500, 1, where="1=050"),
        "claim_contact_information": _o("PER", 20600, 2, codes={"1": "CX"}), "claim_supplemental_information": _o("AMT", 20620, 13), "claim_supplemental_information_quantity": _o("QTY", 20640, 14)}},
    "2110": {"parent": "2100", "trigger": {"segment": "SVC"}, "max": 999, "occurrences": {
        "service_payment_information": _o("SVC", 20700, 1, True), "service_date": _o("DTM", 20800, 2, where="1=150,151,472"), "service_adjustment": _o("CAS", 20900, 99),
        "service_identification": _o("REF", 21000, 8, where="1=1S,APC,BB,E9,G1,G3,LU,RB"), "line_item_control_number": _o("REF", 21000, 1, where="1=6R"),
        "rendering_provider_information": _o("REF", 21000, 10, where="1=0B,1A,1B,1C,1D,1G,1H,1J,D3,G2,HPI,SY,TJ"), "healthcare_policy_identification": _o("REF", 21000, 5, where="1=0K"),
        "service_supplemental_amount": _o("AMT", 21100, 9), "service_supplemental_quantity": _o("QTY", 21200, 6), "healthcare_remark_codes": _o("LQ", 21300, 99)}},
}


def _columns(text: str) -> dict:
    """Lines `name = SEGnn[-c] [*q] [in loop] [phi]`: element (component) of the segment whose first element is q."""
    out = {}
    for line in text.strip().splitlines():
        name, _, rest = line.partition("=")
        words = rest.split()
        place, _, part = words[0].partition("-")
        source: dict = {"segment": place[:-2], "element": int(place[-2:])}
        if part:
            source["component"] = int(part)
        for w in words[1:]:
            if w[0] == "*":
                source["where"] = {"1": w[1:]}
            elif w[0] == "@":
                source["loop"] = w[1:]
            else:
                source["phi"] = w
        out[name.strip()] = source
    return out


# Names and sources of the columns.
_PAYMENTS = """
handling_code = BPR01
total_payment_amount = BPR02
credit_debit_flag = BPR03
payment_method = BPR04
payment_format = BPR05
payment_date = BPR16
trace_number = TRN02
payer_identifier = TRN03
receiver_id = REF02 *EV
production_date = DTM02 *405
payer_name = N102 @1000A
payer_id_qualifier = N103 @1000A
payer_id = N104 @1000A
payer_address = N301 @1000A
payer_city = N401 @1000A
payer_state = N402 @1000A
payer_zip = N403 @1000A
payer_technical_contact_name = PER02 *BL @1000A
payer_technical_contact_qualifier = PER03 *BL @1000A
payer_technical_contact_number = PER04 *BL @1000A
payee_name = N102 @1000B
payee_id_qualifier = N103 @1000B
payee_id = N104 @1000B
payee_address = N301 @1000B
payee_city = N401 @1000B
payee_state = N402 @1000B
payee_zip = N403 @1000B
"""
_CLAIMS = """
claim_id = CLP01 id
claim_status = CLP02
charge_amount = CLP03
payment_amount = CLP04
patient_responsibility = CLP05
filing_indicator = CLP06
payer_control_number = CLP07 id
facility_type = CLP08
frequency_code = CLP09
drg_code = CLP11
drg_weight = CLP12
discharge_fraction = CLP13
header_number = LX01 @2000
patient_last_name = NM103 *QC name
patient_first_name = NM104 *QC name
patient_id_qualifier = NM108 *QC
patient_id = NM109 *QC id
rendering_provider_entity_type = NM102 *82
rendering_provider_name = NM103 *82
rendering_provider_id_qualifier = NM108 *82
rendering_provider_id = NM109 *82
statement_from = DTM02 *232 date
statement_to = DTM02 *233 date
coverage_amount = AMT02 *AU
group_number = REF02 *1L id
"""
_SERVICES = """
procedure_qualifier = SVC01-1
procedure_code = SVC01-2
charge_amount = SVC02
payment_amount = SVC03
units_paid = SVC05
original_units = SVC07
service_date = DTM02 *472 date
line_item_control_number = REF02 *6R id
allowed_amount = AMT02 *B6
"""
_CAS_AMOUNTS, _PLB_AMOUNTS = list(range(3, 19, 3)), list(range(4, 15, 2))


def _organization(table: str, prefix: str) -> dict:
    fields = ["name", "id", "address", "city", "state", "zip"]
    shown = {"id": "identification_code", "zip": "zip_code"}
    return {"row": {"table": table, "fields": [{"name": shown.get(f, f), "column": f"{prefix}_{f}"} for f in fields]}}


def spec_5010() -> dict:
    term = lambda occurrence, places, loop=None, sign=None: {"occurrence": occurrence, "elements": places, **({"loop": loop} if loop else {}), **({"sign": sign} if sign else {})}
    return {
        "name": "835",
        "version": {"segment": "GS", "element": 8, "values": ["005010X221A1", "005010X221", "005010"]},
        "loops": _LOOPS,
        "segments": _segments(),
        "tables": {
            "payments": {"loops": ["transaction"], "ref": "payment", "columns": _columns(_PAYMENTS)},
            "claims": {"loops": ["2100"], "ref": "claim", "phi_seed": "patient_id", "columns": _columns(_CLAIMS)},
            "services": {"loops": ["2110"], "ref": "service", "columns": _columns(_SERVICES)},
            "adjustments": {"loops": ["2100", "2110"], "segment": "CAS", "repeat": {"from": 2, "step": 3}, "columns": {
                "group_code": {"element": 1}, "reason_code": {"group_element": 0}, "amount": {"group_element": 1}, "quantity": {"group_element": 2}}},
            "provider_adjustments": {"loops": ["transaction"], "segment": "PLB", "repeat": {"from": 3, "step": 2}, "columns": {
                "provider_id": {"element": 1}, "fiscal_period_date": {"element": 2}, "reason_code": {"group_element": 0, "component": 1},
                "reference_id": {"group_element": 0, "component": 2, "phi": "id"}, "amount": {"group_element": 1}}},
        },
        "balancing": {
            "service_balance": {"per": "2110", "target": [term("service_payment_information", [2]), term("service_payment_information", [3], sign="-")], "sum": [term("service_adjustment", _CAS_AMOUNTS)]},
            "claim_balance": {"per": "2100", "target": [term("claim_payment_information", [3]), term("claim_payment_information", [4], sign="-")], "sum": [term("claim_adjustment", _CAS_AMOUNTS), term("service_adjustment", _CAS_AMOUNTS, "2110")]},
            "transaction_balance": {"per": "transaction", "target": [term("financial_information", [2])], "sum": [term("claim_payment_information", [4], "2100"), term("provider_adjustment", _PLB_AMOUNTS, sign="-")]},
        },
        "summaries": {
            "count_claims": {"count": {"table": "claims"}},
            "count_patients": {"distinct": {"table": "claims", "column": "patient_id"}},
            "sum_payments": {"sum": {"table": "payments", "column": "total_payment_amount"}},
            "payer": _organization("payments", "payer"),
            "payee": _organization("payments", "payee"),
        },
        "default_table": "claims",
    }


def patch_4010() -> dict:
    """What the older guide has otherwise. Its version, codes and limits."""
    gone = dict.fromkeys
    listed = lambda text: {"codes": text.split()}
    return {
        "version": {"values": ["004010X091A1", "004010X091", "004010"]},
        "loops": {
            "1000A": {"occurrences": {**gone(["payer_technical_contact_information", "payer_web_site"]), "payer_business_contact_information": {"qualifier": None, "codes": None}}},
            "1000B": {"occurrences": {"remittance_delivery_method": None, "payee_identification": {"codes": {"3": ["FI", "XX"]}}, "payee_additional_identification": {"codes": {"1": "0B 1A 1B 1C 1D 1E 1F 1G 1H D3 G2 N5 PQ TJ".split()}}}},
            "2100": {"occurrences": {
                **gone(["other_subscriber_name", "statement_from_or_to_date", "coverage_expiration_date", "claim_received_date"]),
                "insured_name": {"codes": {"8": ["34", "HN", "MI"]}},
                "corrected_priority_payer_name": {"max": 2},
                "other_claim_related_identification": {"qualifier": listed("1L 1W 9A 9C A6 BB CE EA F8 G1 G3 IG SY")},
                "rendering_provider_identification": {"qualifier": listed("1A 1B 1C 1D 1G 1H D3 G2")},
                "claim_date": {"segment": "DTM", "pos": 20500, "max": 4, "codes": {"1": ["036", "050", "232", "233"]}},
                "claim_contact_information": {"codes": None, "max": 3},
                "claim_supplemental_information": {"max": 14, "codes": {"1": "AU D8 DY F5 I NL T T2 ZK ZL ZM ZN ZO ZZ".split()}},
                "claim_supplemental_information_quantity": {"max": 15}}},
            "2110": {"occurrences": {
                **gone(["line_item_control_number", "healthcare_policy_identification"]),
                "service_date": {"max": 3},
                "service_identification": {"max": 7, "qualifier": listed("1S 6R BB E9 G1 G3 LU RB")},
                "rendering_provider_information": {"qualifier": listed("1A 1B 1C 1D 1G 1H 1J HPI SY TJ")},
                "service_supplemental_amount": {"max": 12, "codes": {"1": "B6 DY KH NE T T2 ZK ZL ZM ZN ZO".split()}},
                "service_supplemental_quantity": {"codes": {"1": "NE ZK ZL ZM ZN ZO".split()}}}},
        },
        "segments": {
            "ISA": {"elements": {"11": {"type": "ID", "codes": ["U"]}, "12": {"codes": ["00401"]}}},
            "GS": {"elements": {"8": {"codes": ["004010X091A1", "004010X091", "004010"]}}},
            "ST": {"elements": {"3": None}},
            "REF": {"elements": {"1": listed("0B 1A 1B 1C 1D 1E 1F 1G 1H 1J 1L 1S 1W 2U 6R 9A 9C A6 BB CE D3 E9 EA EO EV F2 F8 G1 G2 G3 HI HPI IG LU N5 NF PQ RB SY TJ")}},
            "N1": {"elements": {"2": {"required": False}}},
            "N4": {"elements": {"2": {"required": True}, "3": {"required": True}, "7": None}},
            "PER": {"elements": {"1": {"codes": ["CX"]}, "3": listed("EM FX TE"), "5": listed("EM EX FX TE"), "7": {"codes": ["EX"]}}},
            "RDM": None,
            "TS3": {"elements": {
                "6": element("total_covered_charge_amount R 1-18"), "7": element("total_noncovered_charge_amount R 1-18"), "8": element("total_denied_charge_amount R 1-18"), "9": element("total_provider_payment_amount R 1-18"),
                "10": element("total_interest_amount R 1-18"), "11": element("total_contractual_adjustment_amount R 1-18"), "12": element("total_gramm_rudman_reduction_amount R 1-18"), "14": element("total_blood_deductible_amount R 1-18"),
                "16": element("total_coinsurance_amount R 1-18"), "19": element("total_deductible_amount R 1-18")}},
            "CLP": {"elements": {"2": {"codes": None}, "6": listed("12 13 14 15 16 AM CH DS HM LM MA MB MC OF TV VA WC ZZ"), "7": {"required": False}, "9": listed("0 1 2 3 4 5 6 7 8 9 A B C D E F G H I J K L M N O X Y Z"), "14": None}},
            "CAS": {"elements": {"1": {"codes": ["CO", "CR", "OA", "PI", "PR"]}}},
            "NM1": {"elements": {"1": listed("74 82 IL PR QC TT")}},
            "AMT": {"elements": {"1": listed("AU B6 D8 DY F5 I KH NE NL T T2 ZK ZL ZM ZN ZO ZZ")}},
            "QTY": {"elements": {"1": listed("CA CD LA LE NA NE NR OU PS VS ZK ZL ZM ZN ZO")}},
            "SVC": {"elements": {at: {"composite": {"1": listed("AD ER HC ID IV N4 NU RB ZZ"), "8": None}} for at in ("1", "6")}},
        },
    }


def _plain(loops: str, ref: str | None, text: str, segment: str | None = None, repeat: tuple[int, int] | None = None) -> dict:
    """Columns as `name=SEGnn`, `name=SEG*q#` (index of the segment), or in a table with a segment `name=nn`, `name=+k[-c]`."""
    columns = {}
    for word in text.split():
        name, _, place = word.partition("=")
        place, _, loop = place.partition("@")
        if segment:
            head, _, part = place.partition("-")
            columns[name] = {"group_element" if head[0] == "+" else "element": int(head)} | ({"component": int(part)} if part else {})
        elif place.endswith("#"):
            seg, _, q = place[:-1].partition("*")
            columns[name] = {"segment": seg, "segment_index": True} | ({"where": {"1": q}} if q else {})
        else:
            head, _, part = place.partition("-")
            columns[name] = {"segment": head[:-2], "element": int(head[-2:])} | ({"component": int(part)} if part else {})
        if loop:
            columns[name]["loop"] = loop
    return {"loops": loops.split(), "columns": columns} | ({"ref": ref} if ref else {}) | ({"segment": segment} if segment else {}) | ({"repeat": {"from": repeat[0], "step": repeat[1]}} if repeat else {})


def patch_wide() -> dict:
    """Seventeen finer tables, from which the wide frame is made. Their names and columns."""
    groups = "group=1 code=+0 amount=+1 quantity=+2"
    return {
        "name": "835_wide",
        "summaries": None,
        "default_table": None,
        "segments": {"SVC": {"elements": {"5": element("units_of_service_paid_count AN 1-15"), "7": element("original_units_of_service_count AN 1-15")}}},
        "tables": {
            **dict.fromkeys(["payments", "claims", "services", "adjustments", "provider_adjustments"]),
            "rows_interchanges": _plain("interchange", "interchange", "authorization_information_qualifier=ISA01 sender=ISA06 receiver=ISA08 transmission_date=ISA09 transmission_time=ISA10"),
            "rows_payments": _plain("transaction", "payment", "amount_paid=BPR02 bpr_segment=BPR# payer_segment=N1#@1000A payee_segment=N1#@1000B payment_method=BPR04 routing_number=BPR13 transaction_date=BPR16"),
            "rows_organizations": _plain("1000A 1000B", "organization", "type=N101 name=N102 identification_code=N104 address=N301 address_segment=N3# city=N401 state=N402 zip_code=N403 location_segment=N4#"),
            "rows_provider_adjustments": _plain("transaction", None, "provider_id=1 fiscal_period_date=2 reason_code=+0-1 reference_id=+0-2 amount=+1", "PLB", (3, 2)),
            "rows_claims": _plain("2100", "claim", "marker=CLP01 status=CLP02 charge_amount=CLP03 paid_amount=CLP04 claim_type=CLP06 icn=CLP07 patient_segment=NM1*QC# rendering_provider_segment=NM1*82# statement_period_start_segment=DTM*232# statement_period_end_segment=DTM*233#"),
            "rows_claim_entities": _plain("2100", None, "entity=1 type=2 last_name=3 first_name=4 identification_code_qualifier=8 identification_code=9", "NM1"),
            "rows_claim_references": _plain("2100", None, "qualifier=1 value=2", "REF"),
            "rows_claim_dates": _plain("2100", None, "qualifier=1 date=2", "DTM"),
            "rows_claim_amounts": _plain("2100", None, "qualifier=1 amount=2", "AMT"),
            "rows_claim_adjustments": _plain("2100", None, groups, "CAS", (2, 3)),
            "rows": _plain("2110", "service", "qualifier=SVC01-1 code=SVC01-2 modifier=SVC01-3 charge_amount=SVC02 paid_amount=SVC03 allowed_units=SVC05 billed_units=SVC07 service_date_segment=DTM*472# service_period_start_segment=DTM*150# service_period_end_segment=DTM*151#"),
            "rows_service_dates": _plain("2110", None, "qualifier=1 date=2", "DTM"),
            "rows_service_amounts": _plain("2110", None, "qualifier=1 amount=2", "AMT"),
            "rows_adjustments": _plain("2110", None, "group=1 code=2 amount=3", "CAS"),
            "rows_adjustment_groups": _plain("2110", None, groups, "CAS", (2, 3)),
            "rows_references": _plain("2110", None, "qual=1 value=2", "REF"),
            "rows_remarks": _plain("2110", None, "qual=1 code=2", "LQ"),
        },
    }


VERSIONS = ("5010", "4010")


def builtin(version: str = "5010", wide: bool = False):
    """The compiled specification of a version."""
    return _compiled(version, bool(wide))


@lru_cache(8)
def _compiled(version: str, wide: bool):
    from remitta.plans.spec import Spec

    if version not in VERSIONS:
        raise ValueError(f"unknown version {version!r}; the built-in ones are {', '.join(VERSIONS)}")
    spec = Spec(spec_5010())
    if version == "4010":
        spec = spec.patch(patch_4010())
    return spec.patch(patch_wide()) if wide else spec
