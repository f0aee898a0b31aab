"""Schemas of the raw files and the engine's tables, as DDL."""

from __future__ import annotations

#: Columns of the raw files, by position (sold prices have no header) or by name.
SALES_COLUMNS = (
    "transaction_id",
    "price",
    "transfer_date",
    "postcode",
    "property_type",
    "new_build_flag",
    "tenure",
    "paon",
    "saon",
    "street",
    "locality",
    "town_city",
    "district",
    "county",
    "ppd_category",
    "record_status",
)
RAW_SALES = ", ".join(f"{c} string" for c in SALES_COLUMNS)
RAW_POSTCODES = "pcd string, pcds string, oslaua string, lat string, long string, lsoa11 string"
RAW_CERTIFICATES = ("POSTCODE", "ADDRESS1", "ADDRESS", "POSTTOWN", "LOCAL_AUTHORITY_LABEL", "CURRENT_ENERGY_RATING", "TOTAL_FLOOR_AREA", "CURRENT_ENERGY_EFFICIENCY", "BUILT_FORM", "PROPERTY_TYPE", "LODGEMENT_DATE")

#: Columns of the engine's tables.
POSTCODES = "id long, postcode string, postcode_with_space string, postcode_clean string, local_authority_code string, latitude double, longitude double"
SALES = "id long, transaction_id string, postcode string, postcode_clean string, house_number string, building_name string, unit string, street string, locality string, town_city string, district string, county string, full_address string, price long, transfer_date string, property_type string, new_build_flag string, tenure string"
CERTIFICATES = "id long, postcode string, postcode_clean string, address1 string, address string, posttown string, local_authority string, full_address string, house_number string, epc_rating string, floor_area double, energy_efficiency double, built_form string, property_subtype string, lodgement_date string, latitude double, longitude double"
FEATURES = (
    "id long, full_address string, postcode string, postcode_clean string, postcode_sector string, house_number string, latitude double, longitude double, "
    "epc_rating string, floor_area double, energy_efficiency double, built_form string, property_subtype string, "
    "last_sold_price long, last_transfer_date string, indexed_last_sold_price double, postcode_average_price double, postcode_average_per_sqm double, "
    "nearest_station_name string, nearest_station_zone string, nearest_station_distance_km double, "
    "nearest_school_name string, nearest_school_type string, nearest_school_distance_km double, nearest_primary_school_distance_km double, nearest_secondary_school_distance_km double, nearby_primary_schools_1km int, nearby_secondary_schools_2km int, "
    "nearest_hospital_name string, nearest_hospital_distance_km double, "
    "crime_lsoa_code string, crime_lsoa_name string, crime_total_12m double, crime_avg_monthly_12m double, crime_level string, "
    "london_hpi_current_index double, london_hpi_at_last_sale double, london_hpi_annual_change_pct double"
)
