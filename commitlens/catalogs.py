"""Reference lists that decide which charges a commitment can cover.

Fixed values: the service names, categories and SKU description prefixes below are facts about
the cloud provider's commitment offers. Reports are only right with exactly these texts, in this
case and spacing ("Series" and "series", "Dedicated Host" and "DedicatedHost" both occur).
"""

# Services that can be bought under a reservation or savings plan, by family.
ELIGIBLE_SERVICES = {
    "compute": (
        "Virtual Machines",
        "Azure Dedicated Host",
        "Azure Functions",
        "Azure Container Instances",
        "Azure Container Apps",
        "Azure Kubernetes Service",
        "Azure Batch",
        "Azure Spring Apps",
        "Azure Virtual Desktop",
        "Azure VMware Solution",
    ),
    "database": (
        "Azure SQL Database",
        "Azure SQL Managed Instance",
        "SQL Database",
        "SQL Managed Instance",
        "Azure Cosmos DB",
        "Cosmos DB",
        "Azure Database for MySQL",
        "Azure Database for PostgreSQL",
        "Azure Database for MariaDB",
        "Azure Cache for Redis",
    ),
    "analytics": (
        "Azure Synapse Analytics",
        "Synapse Analytics",
        "Azure Databricks",
        "Databricks",
        "Azure Data Explorer",
        "Azure Data Factory",
        "Microsoft Fabric",
        "Power BI Embedded",
    ),
    "storage": (
        "Azure Blob Storage",
        "Storage",
        "Blob Storage",
        "Azure Files",
        "Azure Disk Storage",
        "Managed Disks",
        "Azure Backup",
        "Azure NetApp Files",
    ),
    "app": (
        "Azure App Service",
        "App Service",
        "App Service Environment",
    ),
    "ai": (
        "Azure OpenAI Service",
        "Azure OpenAI",
        "OpenAI Service",
        "Azure AI Foundry",
        "Azure Machine Learning",
    ),
    "security": (
        "Microsoft Defender for Cloud",
        "Microsoft Sentinel",
        "Azure Sentinel",
    ),
    "networking": (
        "Azure Virtual WAN",
        "Virtual WAN",
        "Azure ExpressRoute",
        "ExpressRoute",
    ),
    "other": (
        "Azure SignalR Service",
        "SignalR Service",
    ),
}

# Service categories that are eligible whatever the service is called.
ELIGIBLE_CATEGORIES = ("Compute", "Databases", "Analytics", "AI and Machine Learning")

# Families and category that count as compute when a savings plan is sized by service.
COMPUTE_FAMILIES = ("compute", "app")
COMPUTE_CATEGORIES = ("Compute",)

# Starts of the SKU descriptions a compute savings plan covers. A description goes on after its
# prefix with the machine size and the region.
COMPUTE_PLAN_SKU_PREFIXES = tuple(
    """\
Azure App Service Isolated v2 Plan
Azure App Service Premium v3 Plan
Azure App Service Premium v4 Plan
Azure Container Apps
Azure Spring Apps Enterprise
Container Instances
DCadsv5-series Linux
DCasv5-series Linux
DCdsv3 Series Linux
DCsv2 Series Dedicated Host
DCsv3 Series Linux
DSv3 Series Dedicated Host
DSv4 Series Dedicated Host
Dadsv5 Series Dedicated Host
Dasv4 Series Dedicated Host
Dasv5 Series Dedicated Host
Dasv6 Series Dedicated Host
Ddsv4 Series Dedicated Host
Ddsv5 Series DedicatedHost
Ddsv6 Series DedicatedHost
Dsv5 Series DedicatedHost
Dsv6 Series Dedicated Host
ECadsv5-series Linux
ECasv5-series Linux
ESv3 Series Dedicated Host
ESv4 Series Dedicated Host
Eadsv5 Series DedicatedHost
Easv4 Series Dedicated Host
Easv5 Series DedicatedHost
Easv6 Series Dedicated Host
Ebdsv5 Series Dedicated Host
Ebsv5 Series Dedicated Host
Edsv4 Series Dedicated Host
Edsv5 Series DedicatedHost
Esv5 Series DedicatedHost
Esv6 Series DedicatedHost
FSv2 Series Dedicated Host
FX Series Dedicated Host
Flex Consumption
LSv2 Series Dedicated Host
Lasv3 Series DedicatedHost
Lasv3 Series Linux
Lsv3 Series Dedicated Host
MS Series Dedicated Host
MSv2 Series Dedicated Host
MdSv2 Series Dedicated Host
NCads A100 v4 Series Linux
NVSv3 Series Dedicated Host
NVasv4 Series Dedicated Host
Premium Functions
Virtual Machines Av2 Series
Virtual Machines BS Series
Virtual Machines Basv2 Series
Virtual Machines Bpsv2 Series
Virtual Machines Bsv2 Series
Virtual Machines D Series
Virtual Machines DCSv2 Series
Virtual Machines DCadsv6 series
Virtual Machines DCasv6 series
Virtual Machines DCedsv6 Series
Virtual Machines DCesv6 Series
Virtual Machines DS Series
Virtual Machines DSv2 Series
Virtual Machines DSv3 Series
Virtual Machines Dadsv5 Series
Virtual Machines Dadsv6 Series
Virtual Machines Dadsv7 Series
Virtual Machines Daldsv6 Series
Virtual Machines Daldsv7 Series
Virtual Machines Dalsv6 Series
Virtual Machines Dalsv7 Series
Virtual Machines Dasv4 Series
Virtual Machines Dasv5 Series
Virtual Machines Dasv6 Series
Virtual Machines Dasv7 Series
Virtual Machines Dav4 Series
Virtual Machines Ddsv4 Series
Virtual Machines Ddsv5 Series
Virtual Machines Ddsv6 Series
Virtual Machines Ddv4 Series
Virtual Machines Ddv5 Series
Virtual Machines Dldsv5 Series
Virtual Machines Dldsv6 Series
Virtual Machines Dlsv5 Series
Virtual Machines Dlsv6 Series
Virtual Machines Dpdsv5 Series
Virtual Machines Dpdsv6 Series
Virtual Machines Dpldsv5 Series
Virtual Machines Dpldsv6 Series
Virtual Machines Dplsv5 Series
Virtual Machines Dplsv6 Series
Virtual Machines Dpsv5 Series
Virtual Machines Dpsv6 Series
Virtual Machines Dsv4 Series
Virtual Machines Dsv5 Series
Virtual Machines Dsv6 Series
Virtual Machines Dv2 Series
Virtual Machines Dv3 Series
Virtual Machines Dv4 Series
Virtual Machines Dv5 Series
Virtual Machines ECadsv6 series Linux
Virtual Machines ECasv6 series
Virtual Machines ECedsv6 Series
Virtual Machines ECesv6 Series
Virtual Machines ESv3 Series
Virtual Machines Eadsv5 Series
Virtual Machines Eadsv6 Series
Virtual Machines Eadsv7 Series
Virtual Machines Easv4 Series
Virtual Machines Easv5 Series
Virtual Machines Easv6 Series
Virtual Machines Easv7 Series
Virtual Machines Eav4 Series
Virtual Machines Ebdsv5 Series
Virtual Machines Ebdsv6-Series Linux
Virtual Machines Ebsv5 Series
Virtual Machines Ebsv6-Series Linux
Virtual Machines Edsv4 Series
Virtual Machines Edsv5 Series
Virtual Machines Edsv6 Series
Virtual Machines Edv4 Series
Virtual Machines Edv5 Series
Virtual Machines Epdsv5 Series
Virtual Machines Epdsv6 Series
Virtual Machines Epsv5 Series
Virtual Machines Epsv6 Series
Virtual Machines Esv4 Series
Virtual Machines Esv5 Series
Virtual Machines Esv6 Series
Virtual Machines Ev3 Series
Virtual Machines Ev4 Series
Virtual Machines Ev5 Series
Virtual Machines F Series
Virtual Machines FS Series
Virtual Machines FSv2 Series
Virtual Machines FX Series
Virtual Machines FXmdsv2 Series
Virtual Machines FXmsv2 Series
Virtual Machines Fadsv7 Series
Virtual Machines Faldsv7 Series
Virtual Machines Falsv6 Series
Virtual Machines Falsv7 Series
Virtual Machines Famdsv7 Series
Virtual Machines Famsv6 Series
Virtual Machines Famsv7 Series
Virtual Machines Fasv6 Series
Virtual Machines Fasv7 Series
Virtual Machines H Series
Virtual Machines HBS Series
Virtual Machines HBSv2 Series
Virtual Machines HBrsv3 Series
Virtual Machines HBrsv4 series
Virtual Machines HCS Series
Virtual Machines HXrs Series
Virtual Machines LS Series
Virtual Machines LSv2 Series
Virtual Machines Laosv4 Series
Virtual Machines Lasv4 Series
Virtual Machines Lsv3 Series
Virtual Machines Lsv4 Series
Virtual Machines MS Series
Virtual Machines MSv2 Series
Virtual Machines Mbdsv3 Series
Virtual Machines Mbsv3 Series
Virtual Machines MdSv2 Series
Virtual Machines Mdsv3 High Memory Series Linux
Virtual Machines Mdsv3 Medium Memory Series DedicatedHost
Virtual Machines Mdsv3 Medium Memory Series Linux
Virtual Machines Mdsv3 Very High Memory Series Linux
Virtual Machines Msv3 High Memory Series Linux
Virtual Machines Msv3 Medium Memory Series DedicatedHost
Virtual Machines Msv3 Medium Memory Series Linux
Virtual Machines NCSv3 Series
Virtual Machines NCadsH100v5 Series
Virtual Machines NCasT4 v3 Series
Virtual Machines NDamsr A100 v4 Series Linux
Virtual Machines NDasr A100 v4 Series
Virtual Machines NDrSv2 Series
Virtual Machines NP Series
Virtual Machines NVSv3 Series
Virtual Machines NVadsA10v5 Series
Virtual Machines NVadsV710v5 Series
Virtual Machines NVasv4 Series
Virtual Machines D/DS Series
Virtual Machines Dv2/DSv2 Series
Virtual Machines Dv3/DSv3 Series
Virtual Machines Dv4/Dsv4 Series
Virtual Machines Dv5/Dsv5 Series
Virtual Machines Ev3/ESv3 Series
Virtual Machines Ev4/Esv4 Series
Virtual Machines Ev5/Esv5 Series
Virtual Machines F/FS Series
""".splitlines()
)


def service_names(*families: str) -> list[str]:
    """Service names of the given families, or of all families when none is named."""
    return [name for family in families or ELIGIBLE_SERVICES for name in ELIGIBLE_SERVICES[family]]
