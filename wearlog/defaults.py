"""Names in the diaries that the reports treat in a special way.

All of them are only defaults of operator parameters.
"""

PLACEHOLDER_ITEMS = ("ADD NEXT",)
COST_EXCLUDED_CATEGORIES = ("Sportswear",)
RARELY_WORN_EXCLUDED_CATEGORIES = ("Underwear and socks", "Other")
GAP_EXCLUDED_CATEGORIES = ("Accessories", "Other")
DROPPED_STUDY_CATEGORY = "Other"
DROPPED_STUDY_ITEMS = ("Accessories", "glasses")  # category, text within the item name
END_OF_USER_LIST = "END OF LIST"
USED_MARK = "Used"
FORM_DATE, FORM_TIMESTAMP = "Diary entry date", "Timestamp"
PLOT_SIZE_ACTIVE, PLOT_SIZE_DIVESTED = 0.05, 0.07
DAYS_PER_MONTH = 30.5
PRICE_AND_WEAR_CEILING = 150
