"""The tags under which filings report a concept, in the order in which they are tried."""

from __future__ import annotations

# Concepts and their tags.
CONCEPT_TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "net sales": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "net revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "cost of goods sold": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
    "cost of sales": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
    "gross profit": ["GrossProfit"],
    "operating income": ["OperatingIncomeLoss"],
    "operating income (loss)": ["OperatingIncomeLoss"],
    "income from operations": ["OperatingIncomeLoss"],
    "net income": ["NetIncomeLoss"],
    "net income (loss)": ["NetIncomeLoss"],
    "net income attributable to non-controlling interests": ["NetIncomeLossAttributableToNoncontrollingInterest"],
    "net income attributable to noncontrolling interests": ["NetIncomeLossAttributableToNoncontrollingInterest"],
    "equity in earnings of affiliates": ["IncomeLossFromEquityMethodInvestments"],
    "equity in earnings": ["IncomeLossFromEquityMethodInvestments"],
    "selling general and administrative expenses": ["SellingGeneralAndAdministrativeExpense"],
    "marketing and administrative expenses": ["SellingGeneralAndAdministrativeExpense"],
    "research and development expenses": ["ResearchAndDevelopmentExpense"],
    "research and development": ["ResearchAndDevelopmentExpense"],
    "income tax expense": ["IncomeTaxExpenseBenefit"],
    "income tax expense (benefit)": ["IncomeTaxExpenseBenefit"],
    "provision for income taxes": ["IncomeTaxExpenseBenefit"],
    "provision for taxes on income": ["IncomeTaxExpenseBenefit"],
    "total tax provision": ["IncomeTaxExpenseBenefit"],
    "interest expense": ["InterestExpense", "InterestAndDebtExpense"],
    "interest expense net": ["InterestExpense", "InterestAndDebtExpense"],
    "depreciation and amortization": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization"],
    "depreciation and depletion": ["DepreciationDepletionAndAmortization", "Depreciation"],
    "amortization expense": ["AmortizationOfIntangibleAssets", "DepreciationDepletionAndAmortization"],
    "earnings per share (basic)": ["EarningsPerShareBasic"],
    "earnings per share (diluted)": ["EarningsPerShareDiluted"],
    "basic earnings per share": ["EarningsPerShareBasic"],
    "diluted earnings per share": ["EarningsPerShareDiluted"],
    "weighted average shares outstanding": ["WeightedAverageNumberOfSharesOutstandingBasic", "WeightedAverageNumberOfDilutedSharesOutstanding"],
    "weighted average shares outstanding (diluted)": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
    "long-term debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
    "short-term debt": ["ShortTermBorrowings", "NotesPayableCurrent"],
    "current maturities of long-term debt": ["LongTermDebtCurrent"],
    "debt extinguishment costs": ["GainsLossesOnExtinguishmentOfDebt"],
    "total assets": ["Assets"],
    "total liabilities": ["Liabilities"],
    "total equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "total shareholders equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "stockholders equity": ["StockholdersEquity"],
    "retained earnings": ["RetainedEarningsAccumulatedDeficit"],
    "comprehensive income": ["ComprehensiveIncomeNetOfTax", "ComprehensiveIncomeNetOfTaxIncludingPortionAttributableToNoncontrollingInterest"],
    "goodwill": ["Goodwill"],
    "intangible assets": ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"],
    "property plant and equipment net": ["PropertyPlantAndEquipmentNet"],
    "property plant and equipment": ["PropertyPlantAndEquipmentNet", "PropertyPlantAndEquipmentGross"],
    "cash and cash equivalents": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "total inventories": ["InventoryNet"],
    "capital expenditures": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "capital expenditure": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "net cash provided by operating activities": ["NetCashProvidedByUsedInOperatingActivities"],
    "cash dividends paid": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"],
    "dividends paid": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"],
    "deferred tax assets": ["DeferredTaxAssetsGross", "DeferredTaxAssetsNet"],
    "deferred tax liabilities": ["DeferredTaxLiabilities", "DeferredIncomeTaxLiabilitiesNet"],
    "net deferred tax liability": ["DeferredIncomeTaxLiabilitiesNet", "DeferredTaxLiabilities"],
    "unrecognized tax benefits": ["UnrecognizedTaxBenefits"],
    "restructuring charges": ["RestructuringCharges"],
    "operating lease cost": ["OperatingLeaseCost", "LeaseCost"],
    "operating lease liability": ["OperatingLeaseLiability"],
    "stock based compensation expense": ["ShareBasedCompensation", "AllocatedShareBasedCompensationExpense"],
    "pension expense": ["DefinedBenefitPlanNetPeriodicBenefitCost"],
    "projected benefit obligation": ["DefinedBenefitPlanBenefitObligation"],
    "plan assets": ["DefinedBenefitPlanFairValueOfPlanAssets"],
    "impairment loss": ["AssetImpairmentCharges", "GoodwillImpairmentLoss"],
    "accumulated other comprehensive loss": ["AccumulatedOtherComprehensiveIncomeLossNetOfTax"],
}


def rows() -> list[tuple[str, int, str]]:
    """concept, ordinal, tag."""
    return [(concept, k, tag) for concept, tags in CONCEPT_TAGS.items() for k, tag in enumerate(tags)]
